"""Spark-first analytics operators: sources, flags, joins, aggregates, windows, statistics."""
