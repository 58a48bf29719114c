"""Spark-native identity resolution and analytics."""
