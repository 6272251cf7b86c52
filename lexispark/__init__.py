"""Dictionary analytics on Spark: lexicons as DataFrames."""

__version__ = "0.1.0"
