"""docweave: a Spark-native engine for analytics over collections of documents."""

__version__ = "0.1.0"
