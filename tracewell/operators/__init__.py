"""Spark-first operators of the grounding engine."""
