"""fieldloom: a PySpark-native engine for annotation catalogues, raster operators and corpus preparation."""

__version__ = "0.1.0"
