"""lodestone: a Spark-native engine for language-model corpus work and evaluation analytics."""
