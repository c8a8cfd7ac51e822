"""Spark-native terminology mapping and corpus processing."""
