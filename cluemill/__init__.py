"""Spark-native analytics for nested document corpora and the event logs around them."""

__version__ = "0.1.0"
