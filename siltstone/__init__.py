"""siltstone: a Spark-native analytics engine for source code, documents and prompts."""

__version__ = "0.1.0"
