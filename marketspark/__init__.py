"""A PySpark-native market-data analytics engine."""

__version__ = "0.1.0"
