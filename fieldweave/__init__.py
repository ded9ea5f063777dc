"""Spark-native preparation of satellite scenes for machine learning."""
