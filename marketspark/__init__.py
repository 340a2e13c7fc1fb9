"""marketspark: a PySpark-native engine for market analytics."""
