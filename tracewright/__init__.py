"""Spark-native analytics over audit facts: typed tables, graphs, rankings, admission, life cycles, metrics and gates."""
