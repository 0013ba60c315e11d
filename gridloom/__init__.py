"""A Spark-native engine for gridded series."""
