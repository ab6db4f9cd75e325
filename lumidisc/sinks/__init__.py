"""Image encoders, file landing, sheets, loops and manifests."""
