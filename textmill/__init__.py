"""textmill: a Spark-native engine for text-corpus analytics."""
