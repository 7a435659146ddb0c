"""Results as JSON payloads, a document each, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The number of the payload's shape.
SCHEMA = 1
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
FIELD = f"struct<name:string,value:string,status:string,confidence:double,page:int,bbox:{BOX},evidence:string,anchor:string,proof:string,repaired_value:string,notes:array<string>>"
PAYLOAD = f"struct<schema:int,source:string,fields:map<string,{FIELD}>,summary:map<string,bigint>,meta:map<string,string>>"


def finite(x: Column) -> Column:
    """Null for what JSON has no number for."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def sane_text(t: Column) -> Column:
    """A lone half of a surrogate pair becomes a question mark."""
    return F.regexp_replace(t, r"[\ud800-\udfff]", "?")


def payloads(results: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """A document a row: doc_id, json.

    The object holds schema, source, fields by name, summary (counts by status) and meta, without the keys that begin
    with an underscore. results: doc_id, field_ord and the columns of a field, those missing are null; meta: doc_id,
    source, meta (map).
    """
    kinds = dict(x.split(":", 1) for x in FIELD.removeprefix("struct<")[:-1].replace(BOX, "BOX").split(","))
    column = lambda c, k: (F.col(c) if c in results.columns else F.lit(None)).cast(k.replace("BOX", BOX))
    safe = lambda c, k: finite(column(c, k)) if k == "double" else sane_text(column(c, k)) if k == "string" else column(c, k)
    field = F.struct(*[safe(c, k).alias(c) for c, k in kinds.items()])
    rows = results.select("doc_id", "field_ord", "status", field.alias("f"))
    per = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("field_ord", "f"))), lambda x: x["f"]).alias("fs"))
    counts = rows.groupBy("doc_id", "status").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("summary"))
    by_name = F.map_from_entries(F.transform("fs", lambda f: F.struct(f["name"].alias("key"), f.alias("value"))))
    out = per.join(counts, "doc_id")
    out = out.join(meta.select("doc_id", "source", "meta"), "doc_id", "left") if meta is not None else out.withColumns({"source": F.lit(None).cast("string"), "meta": F.lit(None).cast("map<string,string>")})
    open_meta = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, _: ~k.startswith("_"))
    return out.select("doc_id", F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.coalesce("source", F.lit("")).alias("source"), by_name.alias("fields"), F.col("summary"), open_meta.alias("meta"))).alias("json"))


def from_payloads(payloads_: DataFrame) -> DataFrame:
    """The fields of payloads(doc_id, json), a row each; keys that are not known are passed over, and what is no payload gives no rows."""
    read = payloads_.select("doc_id", F.from_json("json", f"p {PAYLOAD}".split(" ", 1)[1]).alias("p"))
    return read.select("doc_id", F.explode("p.fields").alias("name", "f")).select("doc_id", "name", *[f"f.{c}" for c in ("value", "status", "confidence", "page", "bbox", "evidence", "anchor", "proof", "repaired_value", "notes")])


def save_payloads(payloads_: DataFrame, path: str) -> None:
    """A JSON object a line, written whole or not at all by Spark's commit."""
    payloads_.select("json").write.mode("overwrite").text(path)
