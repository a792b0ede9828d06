"""Spark-native analytics over network-latency measurements."""
