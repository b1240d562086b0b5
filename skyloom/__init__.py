"""Spark-native spatial statistics over particle and survey catalogs."""
