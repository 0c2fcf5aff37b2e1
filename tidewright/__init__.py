"""Spark-native analytics over market panels, trade tapes and order books."""

__version__ = "0.1.0"
