"""Spark-native retail reporting and competitor price intelligence."""
