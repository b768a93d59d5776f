"""lumenrank: a Spark-native engine that picks the best items of a large, burst-heavy collection."""
