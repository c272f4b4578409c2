"""Spark-native retrieval, corpus-curation and conversation-analytics operators."""
