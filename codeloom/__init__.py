"""codeloom: code-corpus preparation, structure metrics and evaluation analytics on Spark DataFrames."""

__version__ = "0.1.0"
