"""A PySpark-native engine for catalogues, their references and their texts."""

__version__ = "0.1.0"
