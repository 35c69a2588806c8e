"""Spark-native analytics over curated web-document collections."""
