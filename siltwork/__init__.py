"""siltwork: a Spark-native engine for corpus, retrieval, evaluation and preference data."""
