"""spanloom: a PySpark-native engine for code graphs, traces and the text around them."""

__version__ = "0.1.0"
