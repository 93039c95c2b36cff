"""weftmine: Spark-native mining and factorisation of sparse entity-item data."""
