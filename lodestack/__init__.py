"""lodestack: a Spark-native text and code retrieval store and corpus toolkit."""

__version__ = "0.1.0"
