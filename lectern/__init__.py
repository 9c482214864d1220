"""Spark-native analytics over reading activity and long-form text."""
