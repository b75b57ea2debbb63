"""Spark-native analytics over a knowledge corpus and its telemetry."""
