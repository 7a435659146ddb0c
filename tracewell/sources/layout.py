"""Sources: document bytes, positioned text made from plain text, assertions from JSON, HTML, and the segment store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, layer_is_sane

#: The synthesiser's grid: a character is 6 wide and 10 high, lines are 12 apart.
CHAR, LINE, HEIGHT = 6.0, 12.0, 10.0


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, text): the lines of a text, numbered from 0; null has none."""
    return docs.select(docs[id_col].alias("doc_id"), F.posexplode(F.split(docs[text_col], "\n")).alias("line_no", "text"))


def segments_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain text on the grid, a segment a word: doc_id, page, seg_ord, text, x0, top, x1, bottom, conf.

    A word begins where a space before it ends, so a line's words and the places of its spaces, in order, are all that
    is needed: no shuffle and no sort.
    """
    spaces = F.filter(F.transform(F.split("text", ""), lambda c, i: F.when(c == " ", i + 1)), lambda i: i.isNotNull())
    own = F.arrays_zip(F.split("text", " ").alias("text"), F.concat(F.array(F.lit(0)), spaces).alias("x"))
    words = lines_of(docs, id_col, text_col).select("doc_id", "line_no", F.posexplode(own).alias("k", "w"))
    placed = words.select("doc_id", "line_no", "k", "w.text", "w.x").where("text <> ''")
    return placed.select("doc_id", F.lit(0).alias("page"), (F.col("line_no").cast("long") * (1 << 32) + F.col("k")).alias("seg_ord"), "text", (F.col("x") * CHAR).alias("x0"), (F.col("line_no") * LINE).alias("top"), ((F.col("x") + F.length("text")) * CHAR).alias("x1"), (F.col("line_no") * LINE + HEIGHT).alias("bottom"), F.lit(1.0).alias("conf"))


def routes(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """pages with route: textlayer where the layer is real text, else ocr."""
    return pages.withColumn("route", F.when(layer_is_sane(F.coalesce(pages[text_col], F.lit(""))), "textlayer").otherwise("ocr"))


def assertions_of(extractions: DataFrame, id_col: str = "doc_id", json_col: str = "extraction") -> DataFrame:
    """Asserted values, a row each: doc_id, field_ord, name, value, quote, row (of a table's item), col.

    A JSON object of scalars; of {"value", "quote"} objects; of lists of scalars, which become name[i]; of lists of
    objects, which are tables and become name[i].column. Text that does not parse gives no rows.
    """
    parsed = extractions.select(extractions[id_col].alias("doc_id"), F.try_parse_json(extractions[json_col]).alias("v"))
    tops = parsed.where("v is not null").select("doc_id", F.expr("posexplode(map_entries(try_variant_get(v, '$', 'map<string,variant>')))").alias("field_ord", "e"))
    tops = tops.select("doc_id", F.col("field_ord").alias("pos"), F.col("e.key").alias("top"), F.col("e.value").alias("v"), F.expr("try_variant_get(e.value, '$', 'array<variant>')").alias("items"))
    tops = tops.withColumn("items", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("items")))
    text = "try_variant_get(v, '$', 'string')"
    flat = tops.where("items is null").select("doc_id", "pos", F.lit(None).cast("int").alias("row"), F.lit(None).cast("string").alias("col"), F.col("top").alias("name"), "v")
    each = tops.where("items is not null").select("doc_id", "pos", "top", F.posexplode_outer("items").alias("row", "v"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    scalars = each.where(F.col("v").isNull() | ~is_object).select("doc_id", "pos", "row", F.lit(None).cast("string").alias("col"), F.when(F.col("row").isNull(), F.col("top")).otherwise(F.concat("top", F.lit("["), "row", F.lit("]"))).alias("name"), "v")
    cells = each.where(is_object).select("doc_id", "pos", "top", "row", F.expr("explode(map_entries(try_variant_get(v, '$', 'map<string,variant>')))").alias("e")).select("doc_id", "pos", "row", F.col("e.key").alias("col"), F.concat("top", F.lit("["), "row", F.lit("]."), "e.key").alias("name"), F.col("e.value").alias("v"))
    all_ = flat.unionByName(scalars).unionByName(cells)
    quoted = F.schema_of_variant("v").startswith("OBJECT") & F.expr("try_variant_get(v, '$.value', 'variant') is not null or try_variant_get(v, '$.quote', 'variant') is not null")
    value = F.when(quoted, F.expr("try_variant_get(v, '$.value', 'string')")).otherwise(F.expr(text))
    return all_.select("doc_id", F.col("pos").alias("field_ord"), "name", value.alias("value"), F.when(quoted, F.expr("try_variant_get(v, '$.quote', 'string')")).alias("quote"), "row", "col")


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags off, a few entities read, runs of white space one space."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


class SegmentStore:
    """Segments kept as Parquet by document, so that geometry is made once; rows that are out of shape count as missing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    schema = "doc_id string, page int, seg_ord long, text string, x0 double, top double, x1 double, bottom double, conf double"

    def rows(self) -> DataFrame:
        try:
            kept = self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as missing:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            kept = self.spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) {c}" for c, t in (x.split() for x in self.schema.split(", "))) + " WHERE false")
        return kept.where("x1 >= x0 and bottom >= top and text is not null")

    def missing(self, docs: DataFrame) -> DataFrame:
        return docs.join(self.rows().select("doc_id").distinct(), "doc_id", "left_anti")

    def add(self, segments: DataFrame) -> None:
        segments.selectExpr(*[f"CAST({c} AS {t}) {c}" for c, t in (x.split() for x in self.schema.split(", "))]).write.mode("append").parquet(self.path)


def not_present(assertions: DataFrame) -> DataFrame:
    """Assertions with is_present: false for null and blank values, which are not searched for."""
    return assertions.withColumn("is_present", ~is_blank(F.col("value")))
