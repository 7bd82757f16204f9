"""Spark-native analytics for molecule-tagged sequencing reads at guanine repeats."""

__version__ = "0.1.0"
