"""Spark-first functions of the grounding engine."""
