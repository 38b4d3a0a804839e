"""cairn: a Spark-native engine that indexes, searches, tags and explores document collections."""
