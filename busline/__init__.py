"""Spark-native analytics for message logs of in-vehicle networks."""
