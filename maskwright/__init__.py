"""Spark-native detection, masking and reversible sanitization of sensitive text."""
