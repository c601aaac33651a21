"""Spark-native analytics for experiment journals, numeric corpora and training data."""
