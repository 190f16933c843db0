"""A PySpark-native engine for scoring structured extraction at scale."""
