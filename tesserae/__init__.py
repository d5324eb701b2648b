"""A PySpark-native engine for retrieval over memories, text analytics and training data."""
