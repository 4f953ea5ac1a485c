"""strata: ordered, multi-versioned key/value analytics on PySpark DataFrames."""

__version__ = "0.1.0"
