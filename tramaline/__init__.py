"""Spark-native analytics over translation documents, ledgers and logs."""
