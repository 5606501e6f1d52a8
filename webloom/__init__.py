"""Spark-native analytics for crawled web content."""
