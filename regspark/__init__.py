"""PySpark-native analytics for container-registry measurement data."""

__version__ = "0.1.0"
