"""Spark-native governance of business-intelligence model corpora."""
