"""Spark-first streaming of the grounding engine."""
