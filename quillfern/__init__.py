"""quillfern: a PySpark-native engine for ordered series, intervals and token sequences."""

__version__ = "0.1.0"
