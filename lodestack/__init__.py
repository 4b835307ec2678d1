"""Spark-native analytics over archives of tokenized BASIC programs."""
