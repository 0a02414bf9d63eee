"""tidemark: a Spark-native engine for point-in-time forecasting analytics."""
