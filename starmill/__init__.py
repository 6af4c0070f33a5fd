"""starmill: a Spark-native engine for spatially partitioned catalogs."""

__version__ = "0.1.0"
