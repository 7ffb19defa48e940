"""Tidemark: a Spark-native event-study analytics engine."""
