"""tessera: a Spark-native engine for code and document retrieval."""
