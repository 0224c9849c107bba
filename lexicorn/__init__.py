"""lexicorn: a Spark-native short-text completion and evaluation engine."""

__version__ = "0.1.0"
