"""A training corpus from raw documents: known languages, no copies, no near copies, no benchmark passages, packed.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is written
as Parquet and read again. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, exact_dedup, language, near_copies, packing
from tracewell.llm.common import free_heaps, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a letter, or whose language the network doesn't recognise, go."""
    return language.keep_languages(docs, language.fit_language(docs))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs, exact_dedup.DigestIndex(spark, scratch(spark, "digests")))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8's fingerprints and index, on five-word shingles, and an exact join for what they miss: of texts that links of 0.8 or more in the Jaccard similarity of these shingles join, the smallest doc_id stays."""
    return near_copies.drop_near_copies(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold ten words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of all documents and their places in sequences."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def _freed(stage: Stage) -> Stage:
    """stage, begun after the executors gave back what the one before left of their heaps."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_heaps(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [(name, _freed(stage)) for name, stage in [("language", known_languages), ("exact_dedup", no_copies), ("near_dedup", no_near_copies), ("decontaminate", no_benchmark), ("packing", packed)]]

#: SQL can't run the network of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        to = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return STAGES[-1][1](spark, docs, sf_dir)
