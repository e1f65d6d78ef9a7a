"""Spark-native analytics for market time series, and corpus operators in ``weftline.llm``."""
