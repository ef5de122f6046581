"""Financial-statement analytics for many companies at once, on Spark DataFrames."""

__version__ = "0.1.0"
