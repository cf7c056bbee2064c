"""mentionlab: a PySpark-native engine for text-mention studies."""
