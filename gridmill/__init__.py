"""Spark-native logger-data and file-integrity analytics."""
