"""Spark-first sources of the grounding engine."""
