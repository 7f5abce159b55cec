"""Event-aligned, multi-source analytics on Spark."""
