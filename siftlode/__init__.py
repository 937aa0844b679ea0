"""siftlode: a PySpark-native engine for search candidate generation."""
