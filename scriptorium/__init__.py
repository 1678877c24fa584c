"""A PySpark-native engine for preparing, searching and evaluating text corpora."""

__version__ = "0.1.0"
