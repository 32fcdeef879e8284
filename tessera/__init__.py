"""Spark-native feature analytics: sources, array features, pooling, inference, validation."""
