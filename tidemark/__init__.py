"""Spark-native analytics for streams of short texts about world events."""
