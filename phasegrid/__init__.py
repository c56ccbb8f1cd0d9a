"""Spark-native analytics over array-valued time series."""
