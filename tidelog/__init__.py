"""Tidelog: versioned key-value analytics expressed as Spark DataFrame queries."""
