"""Estimators in numpy and their search on Spark."""
