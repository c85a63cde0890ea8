"""Content-safety and traffic analytics over Spark DataFrames and streams."""

__version__ = "0.1.0"
