"""Operator 5. Exact deduplication against a persistent digest index (DataFrame operations only)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep_only, parts, scratch, table


class DigestIndex:
    """A table of the digests of all texts accepted so far, bucketed and sorted by digest, at a path that outlives the session.

    Columns: digest (SHA-256), keep_id (the document that stays), group_size (rows of its text when it came in), batch.
    n_buckets holds for the life of an index; as many as shuffle partitions, 16 at least, unless it is given.
    """

    schema = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, n_buckets: int | None = None):
        n_buckets = n_buckets or max(16, parts(spark))
        self.spark, self.path, self.n_buckets = spark, path, n_buckets
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n_buckets} BUCKETS LOCATION '{path}'")

    def files(self) -> DataFrame:
        """The index without its bucketing."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, groups: DataFrame, batch: str | None = None) -> str:
        """Append those groups whose digest is new, by a sort-merge anti-join that leaves the index where its buckets lie. Returns the batch's name.

        A batch that the index has already is not appended again, so a job that was lost after this step can be repeated under its name.
        """
        if batch and not self.spark.table(self.name).where(F.col("batch") == batch).isEmpty():
            return batch
        batch = batch or uuid.uuid4().hex
        fresh = groups.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).repartition(self.n_buckets, "digest")
        fresh.write.mode("append").format("parquet").bucketBy(self.n_buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        return batch


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Judge a batch of documents against the index and add its new texts to it.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when their UTF-8
    bytes are; null is the empty text. Of a text that is new, the row with the largest doc_id stays; a text that the
    index has already is dropped whole, and keep_id and group_size are the index's. Of rows equal in text and doc_id
    one stays; null ids are smaller than all others. An empty batch gives no rows and adds none. Other columns are
    not read, so their names can't clash. A batch that is judged again under the same name gets the same answer.

    The batch's texts are read once and only digests move. Rows of one text are counted before the shuffle; the join
    that tells each row its keeper reads the index as plain files, so that Spark can split a hot digest over tasks.
    """
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256))
    members = cut(docs.select(docs[id_col].cast("long").alias("doc_id"), digest.alias("digest")).groupBy("digest", "doc_id").agg(F.count("*").alias("n")))
    batch = index.append(members.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), batch)
    judged = members.join(index.files(), "digest").select("doc_id", "keep_id", "group_size", "digest", "batch", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    kept = (F.col("batch") == batch) & (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return judged.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without what exact_dedup() drops; all columns stay."""
    judged = exact_dedup(docs, index, id_col, text_col)
    keepers = judged.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept")
    return keep_only(docs, keepers.select("doc_id", F.col("text_sha256").alias("key"), "n"), F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256), id_col)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), DigestIndex(spark, scratch(spark, "digests")))
