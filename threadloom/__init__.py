"""Spark-native engine for event-sourced conversation logs, nested documents and text corpora."""
