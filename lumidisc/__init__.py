"""Spark-native analytics for archives of full-disc planetary images."""
