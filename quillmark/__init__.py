"""A Spark-native engine for catalogue retrieval, evaluation and training-data preparation."""
