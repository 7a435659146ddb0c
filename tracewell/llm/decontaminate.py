"""Operator 10. Benchmark decontamination by word windows (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, table

#: Fixed value: what lies between words, once A-Z are lower-cased. Upper-case letters are words here, since lower() comes after.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows beyond so many are joined by a shuffle, not sent to every executor.
BROADCAST_WINDOWS = 2_000_000


def words(text: Column) -> Column:
    """The words of a text, in their own case; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def _grams(ws: Column, n: int) -> Column:
    """The texts of all windows of n words, in their own case."""
    none = F.array().cast("array<string>")
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(none)


def _hash(gram: Column) -> Column:
    """lower() folds more than A-Z, so windows equal as compared have equal hashes; it is much faster than translate()."""
    return F.xxhash64(F.lower(gram))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, n, gram, items): the distinct windows of all items; n is less than window for items of fewer words."""
    items = benchmark.select(benchmark[id_col].alias("item_id"), words(benchmark[text_col].cast("string")).alias("w")).where(F.size("w") > 0)
    out = None
    for n in range(1, window + 1):
        right = F.size("w") >= n if n == window else F.size("w") == n
        grams = items.where(right).select("item_id", F.explode(_grams(F.col("w"), n)).alias("gram")).select("item_id", F.lit(n).alias("n"), _hash(F.col("gram")).alias("h"), F.translate("gram", UPPER, LOWER).alias("gram"))
        out = grams if out is None else out.unionByName(grams)
    return out.groupBy("h", "n", "gram").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, key, at, n, items) for each place of a document's words, from 0, where a window starts.

    Windows meet by hash; then their texts are compared. The comparison is written as containment both ways, since
    Spark would make an equality a second join key and compute it for every window of the corpus.
    """
    small = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    split = docs.select("doc_id", "key", words(F.col("text")).alias("w"))
    out = None
    for n in lengths:
        known = windows.where(F.col("n") == n).select("h", F.col("gram").alias("item_gram"), "items")
        places = split.select("doc_id", "key", F.posexplode(_grams(F.col("w"), n)).alias("at", "gram")).withColumn("h", _hash(F.col("gram")))
        seen = F.translate("gram", UPPER, LOWER)
        found = places.join(F.broadcast(known) if small else known, "h").where(seen.contains(F.col("item_gram")) & F.col("item_gram").contains(seen))
        found = found.select("doc_id", "key", "at", F.lit(n).alias("n"), "items")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find each document's words that lie inside a window of any benchmark item.

    Returns one row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (array of
    struct<first, last>: the maximal runs of hit words, from 0, for callers that cut passages out),
    text_hash. items_sha256 is of
    the empty string where no item occurs. Null and empty texts, of a document or an item, have no words. An item in
    several rows counts as all of them; null item ids are found but not counted. Repeated documents each get their
    row. Columns other than those named are not read. Either table may be empty.

    The windows go to every executor as a hash table while their number is below BROADCAST_WINDOWS, which is counted,
    else both sides are shuffled by hash. Only hits leave the scan.
    """
    windows = cut(benchmark_windows(benchmark, window))
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most `window` numbers
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("text"))
    rows = base.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if not lengths:
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("spans"), F.col("key").alias("text_hash"))
    found = hits(base, windows, lengths).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last")))).alias("places"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string"))).alias("items"),
    )
    start = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    runs = F.aggregate(
        "places",
        F.struct(start.alias("done"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")),
        lambda s, p: F.when(p["first"] <= s["last"] + 1, F.struct(s["done"].alias("done"), s["first"].alias("first"), F.greatest(s["last"], p["last"]).alias("last"))).otherwise(
            F.struct(F.when(s["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"))))).alias("done"), p["first"].alias("first"), p["last"].alias("last"))
        ),
        lambda s: F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last")))),
    )
    found = found.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), runs.alias("spans"), "items")
    joined = rows.join(found, rows.doc_id.eqNullSafe(found.d) & (rows.key == found.k), "left")
    n_hit = F.aggregate(F.coalesce("spans", start), F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("spans", start).alias("spans"), F.col("key").alias("text_hash"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a window of an item; all columns stay."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    judged = decontaminate(docs.select(docs[id_col].alias("doc_id"), text.alias("text")), benchmark, window)
    hit = cut(judged.where("contaminated").select("doc_id", "text_hash").distinct())
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("row_id"), F.xxhash64(text).alias("row_hash"))
    return rows.join(hit, F.col("row_id").eqNullSafe(hit.doc_id) & (F.col("row_hash") == hit.text_hash), "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_hash")
