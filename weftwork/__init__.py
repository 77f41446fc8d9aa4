"""A Spark-native engine that generates, validates, profiles and curates tabular and text data."""

__version__ = "0.1.0"
