"""tradeloom: a PySpark-native engine for trade-document extraction, comparison and reporting."""
