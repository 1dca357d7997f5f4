"""Spark-native engine for personal-finance records and text corpora."""
