"""Spark-native analytics for short posts, long reviews and the statistics around them."""
