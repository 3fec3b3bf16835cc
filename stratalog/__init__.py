"""Spark-native engine for histories of versioned key-to-value sets."""
