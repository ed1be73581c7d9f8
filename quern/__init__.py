"""Spark-native tables, queries and streams."""
