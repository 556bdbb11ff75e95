"""A Spark-native engine for multichannel recordings, retrieval and experiment tracking."""
