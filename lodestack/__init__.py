"""A PySpark-native engine for building, checking and batching instruction datasets."""
