"""pagemill: Spark-native processing of web documentation pages and text corpora."""
