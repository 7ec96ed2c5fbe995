"""Spark-native record linkage, set decision and corpus preparation."""
