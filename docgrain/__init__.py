"""Document analytics and hybrid retrieval on Apache Spark DataFrames."""

__version__ = "0.1.0"
