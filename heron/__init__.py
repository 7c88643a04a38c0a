"""heron: a PySpark-native analytics, retrieval and query-checking engine."""
