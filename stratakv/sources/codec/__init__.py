"""The block-based table format, in Python without Spark."""
