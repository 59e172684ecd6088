"""corvane: Spark-native analytics over source repositories."""

__version__ = "0.1.0"
