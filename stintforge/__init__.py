"""Spark-native impact analytics: event logs to segments, padded rates, ridge ratings and held-out validation."""
