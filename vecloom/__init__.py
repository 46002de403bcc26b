"""vecloom: collections of versioned vectors as Spark DataFrames."""
__version__ = "0.1.0"
