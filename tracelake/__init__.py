"""Spark-native redaction and language-model traffic analytics."""
