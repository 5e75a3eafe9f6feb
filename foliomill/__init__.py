"""PySpark-native document analytics, hybrid retrieval and corpus preparation."""

__version__ = "0.1.0"
