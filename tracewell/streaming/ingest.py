"""Streams of documents: copies dropped, geometry made once, results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that arrive as Parquet files under a path, with the digest of their text."""
    return spark.readStream.schema(schema).parquet(path).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))


def distinct_stream(docs: DataFrame, time_col: str | None = None, within: str = "1 day") -> DataFrame:
    """docs without texts seen before; with a time column only within a span, so that the state is bounded."""
    if time_col is None:
        return docs.dropDuplicates(["sha"])
    return docs.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["sha"])


def ground_stream(docs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Run `work` on each batch of new documents and write its rows under out/batch=N, so that a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        try:
            work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        except Exception as e:
            if on_error:
                on_error(e)
            raise

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(docs: DataFrame, out: str, checkpoint: str) -> None:
    """Write all that a stream has to Parquet, and end."""
    docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
