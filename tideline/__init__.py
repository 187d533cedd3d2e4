"""tideline: a PySpark-native store and query engine for time-series points."""

__version__ = "0.1.0"
