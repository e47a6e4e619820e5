"""siltweir: a Spark-native engine for URL-risk analytics."""
