"""Spark-native analytics over order books, combat-style event streams and relationship graphs."""
