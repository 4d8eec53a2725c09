"""A PySpark-native engine for analytics over versioned property graphs."""
