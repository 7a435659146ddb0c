"""What the corpus operators share: the shared folder, row keys, distributed components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None] | None = None) -> None:
    """A worker process serves this operator from now on. What other operators keep in it is dropped, so that a reused worker has one cache at a time."""
    others = [k for k in _HELD if k != name]
    for other in others:
        _HELD.pop(other)()
    if others:
        give_back()
    if clear:
        _HELD[name] = clear


def give_back() -> None:
    """Return freed memory of this process to the system, which allocators would keep for later; a worker lives on beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_heaps(spark: SparkSession) -> None:
    """Have the executors collect garbage and return heap that is then unused to the system. A heap keeps the size that one step grew it to, and the next step's Python workers come on top. An executor that gets none of the tasks keeps its heap; no result depends on it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir; where that is unset, as in tests, an own one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewell-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation of what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a compressed table in the shared folder; for wide intermediate results, which a checkpoint would keep as plain rows."""
    to = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (u, v), component the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges stay the same: about log2 of the
    longest path rounds. Each step is a map-side-combined minimum and a join whose hot side Spark's adaptive skew
    join splits; no node's neighbours are gathered. Each round is kept in the shared folder. Nulls and loops are
    ignored; an empty input gives no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    n, seen = edges.count(), None
    while n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == seen:
            break
        seen = (now.n, now.s)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def keep_only(docs: DataFrame, keepers: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id and key are among keepers(doc_id, key, n); where n tells that several rows have them, one of these.

    Rows that are one of a kind, nearly all, are not grouped: their texts meet the keepers in a join that Spark makes a
    broadcast where the keepers are few.
    """
    names = docs.columns
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[id_col].cast("long").alias("row_id"), key.alias("row_key"))
    keepers = cut(keepers.select("doc_id", "key", "n"))
    on = held.row_id.eqNullSafe(keepers.doc_id) & held.row_key.eqNullSafe(keepers.key)
    single = held.join(keepers.where("n = 1"), on, "left_semi").select("row.*")
    several = keepers.where("n > 1")
    if several.isEmpty():
        return single
    return single.unionByName(held.join(several, on, "left_semi").groupBy("row_id", "row_key").agg(F.first("row").alias("row")).select("row.*"))
