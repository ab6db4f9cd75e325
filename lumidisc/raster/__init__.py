"""Dense numpy kernels for whole images, and their Arrow wrappers."""
