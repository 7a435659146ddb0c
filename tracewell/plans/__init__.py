"""Spark-first plans of the grounding engine."""
