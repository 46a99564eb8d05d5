"""Spark-native catalogue analytics: operators are functions from DataFrame to DataFrame."""
