"""Spark-native processing of a question-and-answer knowledge base."""
