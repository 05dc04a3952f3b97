"""millrace: data-lake operators for PySpark DataFrames and streams."""

__version__ = "0.1.0"
