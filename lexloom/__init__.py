"""Spark-native engine for localization corpora: documents, blocks, images and regions as tables."""

__version__ = "0.1.0"
