"""shelfmark: a Spark-native analytics engine for ratings, catalogues and text."""

__version__ = "0.1.0"
