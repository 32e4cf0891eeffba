"""Spark-native analytics over transaction captures, graphs and text corpora."""
