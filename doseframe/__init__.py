"""Spark-native analytics for tables of measured compound activity."""
