"""Spark-first recommendation analytics and training-data preparation."""
