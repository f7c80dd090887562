"""Spark-native analytics for statistical genetics, expressed as DataFrame operators."""
