"""colkit: a PySpark-native column toolkit."""

__version__ = "0.1.0"
