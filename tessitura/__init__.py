"""Spark-native analytics of labelled recording collections."""
