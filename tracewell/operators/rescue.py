"""Second chances for fields that were not found: which lines to read again, and what that gave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canon

#: Lines tried for a field, and readings of a page.
LINES, READINGS = 2, 6


def rescue_lines(missing: DataFrame, rows: DataFrame) -> DataFrame:
    """The lines beside which a value that was not found may stand: doc_id, field_ord, page, row_ord, hits, nth.

    missing: doc_id, field_ord, value, quote, anchors. A line counts how many words it holds of the field's quote
    (outside the value), of the value itself and of its labels; the best LINES of a field, of equals the topmost, are
    tried, and READINGS of a page at most, in the order of the fields. Words are looked up by document.
    """
    words = lambda t, n: F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), r"(?U)\s+"), canon), lambda w: F.length(w) >= n)
    labels = F.filter(F.transform(F.coalesce("anchors", F.array().cast("array<string>")), canon), lambda w: F.length(w) >= 3)
    asked = missing.where("value is not null").withColumn("own", canon(F.col("value")))
    beside = F.filter(words(F.col("quote"), 3), lambda w: ~F.contains(F.col("own"), w))
    tokens = asked.select("doc_id", "field_ord", F.explode(F.array_distinct(F.concat(beside, words(F.col("value"), 4), labels))).alias("token"))
    lines = rows.where("not is_cell").select("doc_id", "page", "row_ord", "top", canon(F.col("text")).alias("hay"))
    hits = tokens.join(lines, "doc_id").where(F.contains("hay", "token")).groupBy("doc_id", "field_ord", "page", "row_ord", "top").agg(F.count("*").alias("hits"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "field_ord").orderBy(F.desc("hits"), "page", "top", "row_ord"))
    best = hits.withColumn("nth", nth).where(F.col("nth") <= LINES)
    of_page = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("field_ord", "nth"))
    return best.withColumn("reading", of_page).where(F.col("reading") <= READINGS).select("doc_id", "field_ord", "page", "row_ord", "hits", "nth")


def rescued(results: DataFrame, found: DataFrame) -> DataFrame:
    """results with what a second reading found: found(doc_id, field_ord, nth, page, bbox, evidence, score). The first line that gave a match counts; it is never more than low_confidence, 0.6 at most."""
    first = found.groupBy("doc_id", "field_ord").agg(F.min(F.struct("nth", (-F.col("score")).alias("low"), "page", "bbox", "evidence")).alias("s"))
    r = results.join(first, ["doc_id", "field_ord"], "left")
    hit = (F.col("status") == "not_found") & F.col("s").isNotNull()
    new = {"status": F.when(hit, "low_confidence").otherwise(F.col("status")), "confidence": F.when(hit, F.least(F.lit(0.6), -0.7 * F.col("s.low"))).otherwise(F.col("confidence"))}
    new |= {c: F.when(hit, F.col(f"s.{c}")).otherwise(F.col(c)) for c in ("page", "bbox", "evidence")}
    new["notes"] = F.when(hit, F.array_append(F.coalesce("notes", F.array().cast("array<string>")), "found by a second reading")).otherwise(F.col("notes"))
    return r.select(*[new[c].alias(c) if c in new else c for c in results.columns])
