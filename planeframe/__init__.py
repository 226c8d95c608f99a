"""A PySpark-native engine for sampled-plane data."""
