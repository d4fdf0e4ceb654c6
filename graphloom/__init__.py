"""A Spark-native code-graph engine: files in, a queryable graph of definitions and calls out."""
