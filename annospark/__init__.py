"""Spark-native engine for spatial annotation indexes and segment attributes."""
