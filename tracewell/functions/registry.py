"""The engine's functions for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StringType

BOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
#: Functions that SQL expresses; Spark inlines them.
SQL_FUNCTIONS = {
    "compact_id(s STRING)": ("STRING", "upper(regexp_replace(s, '[\\\\s\\\\-.]', ''))"),
    "ean_valid(s STRING)": ("BOOLEAN", "CASE WHEN compact_id(s) RLIKE '^([0-9]{8}|[0-9]{12,14})$' THEN (10 - aggregate(sequence(1, length(compact_id(s)) - 1), 0, (a, i) -> a + CAST(substr(compact_id(s), i, 1) AS INT) * CASE WHEN (length(compact_id(s)) - i) % 2 = 1 THEN 3 ELSE 1 END) % 10) % 10 = CAST(right(compact_id(s), 1) AS INT) END"),
    "iban_valid(s STRING)": ("BOOLEAN", "compact_id(s) RLIKE '^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$' AND aggregate(filter(split(substr(compact_id(s), 5) || left(compact_id(s), 4), ''), c -> c <> ''), 0, (a, c) -> CASE WHEN c RLIKE '^[0-9]$' THEN (a * 10 + CAST(c AS INT)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"),
    f"bbox_iou(a {BOX}, b {BOX})": ("DOUBLE", "CASE WHEN least(a.x1, b.x1) <= greatest(a.x0, b.x0) OR least(a.y1, b.y1) <= greatest(a.y0, b.y0) THEN 0D ELSE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1e-12D, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) END"),
}


def register(spark: SparkSession) -> None:
    """Make canon, seq_ratio, compact_id, ean_valid, iban_valid, bbox_iou and the table function match_field known to this session's SQL."""
    from ..operators.match import find_value
    from .text import canon_map, seq_ratio

    @F.pandas_udf(StringType())
    def canon(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else canon_map(t)[0])

    spark.udf.register("canon", canon)
    spark.udf.register("seq_ratio", F.pandas_udf(seq_ratio.func, DoubleType()))
    for head, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")

    @udtf(returnType="start: int, end: int, score: double, exact: boolean")
    class MatchField:
        """Where a value of a type stands in a text."""

        def eval(self, ftype: str, value: str, text: str):
            if None not in (ftype, value, text):
                yield from find_value(ftype, value, text, False)

    spark.udtf.register("match_field", MatchField)
