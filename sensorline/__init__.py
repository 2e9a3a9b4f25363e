"""Spark-first analytics over multi-stream sensor recordings."""
