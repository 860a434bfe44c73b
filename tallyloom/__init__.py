"""Spark-native analytics over social content tables, plus training-corpus operators."""
