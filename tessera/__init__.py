"""Spark-native retrieval, text and ledger analytics: composable, lazy DataFrame operators."""
