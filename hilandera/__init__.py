"""Hilandera: a Spark-native engine for deterministic analysis of Spanish text at corpus scale."""
