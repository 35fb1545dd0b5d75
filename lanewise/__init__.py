"""A Spark-native engine for verifying driver and vehicle records, and for preparing corpora."""
