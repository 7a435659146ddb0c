"""Runs over a stream of documents, with their states and their progress."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATES = "batch long, doc_id string, state string, error string, at timestamp"


class Progress:
    """Tells a callable when stages start and end, and sums up their seconds. A callable that fails is warned of once and not called again."""

    def __init__(self, tell: Callable[[str, str], None] | None = None):
        self.tell, self.seconds = tell, {}

    def _say(self, stage: str, event: str) -> None:
        if self.tell is None:
            return
        try:
            self.tell(stage, event)
        except Exception as e:  # whatever the caller's function does, the run goes on
            warnings.warn(f"progress is no longer told: {e}", stacklevel=3)
            self.tell = None

    @contextmanager
    def stage(self, name: str):
        start = time.monotonic()
        self._say(name, "start")
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - start
            self._say(name, "end")


def run_documents(docs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, states: str, checkpoint: str, progress: Progress | None = None) -> StreamingQuery:
    """Run `work` on each batch of a stream of documents (doc_id, ...); results go to out/batch=N, states to states/batch=N.

    A batch's documents are queued, then running, then done or error; the last state counts. A batch that is run again
    replaces what it wrote, so it leaves nothing twice. A batch that fails is marked and the stream goes on. One batch
    is run at a time.
    """
    progress = progress or Progress()

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()

        def mark(state: str, error: str | None = None) -> None:
            rows = batch.select(F.lit(number).cast("long").alias("batch"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(state).alias("state"), F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("at"))
            rows.write.mode("overwrite").parquet(f"{states}/batch={number}/state={state}")

        try:
            for s in ("done", "error"):  # of an earlier try
                _remove(spark, f"{states}/batch={number}/state={s}")
            mark("queued")
            with progress.stage("run"):
                mark("running")
                try:
                    work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
                except Exception as e:  # the batch's error, of any kind, is its state
                    mark("error", f"{type(e).__name__}: {e}"[:500])
                else:
                    mark("done")
        finally:
            batch.unpersist()

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def last_states(spark: SparkSession, states: str) -> DataFrame:
    """batch, doc_id, state, error: the last state of each document of each batch."""
    rows = spark.read.option("basePath", states).schema("doc_id string, error string, at timestamp, batch long, state string").parquet(f"{states}/*/*")
    rank = F.array_position(F.array(*[F.lit(s) for s in ("queued", "running", "done", "error")]), F.col("state"))
    return rows.groupBy("batch", "doc_id").agg(F.max_by(F.struct("state", "error"), rank).alias("s")).select("batch", "doc_id", "s.state", "s.error")


def with_segments(store, docs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Segments of docs from a SegmentStore; those it lacks are made and added first, so no document is read twice."""
    missing = store.missing(docs)
    if not missing.isEmpty():
        store.add(make(missing))
    return store.rows().join(docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
