"""Spark-native climate analytics: DataFrame operators over long climate tables."""
