"""millrace: a Spark-native search, extraction and retrieval engine."""
