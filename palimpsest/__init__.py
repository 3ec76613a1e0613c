"""Spark-native engine for versioned document dumps."""
