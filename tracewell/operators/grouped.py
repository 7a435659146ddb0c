"""Ordered work on many small groups without a call of its own for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """work(rows of a group, in order) gives the group's output rows.

    Groups are hashed over the cluster and sorted within partitions by Spark, which spills; a task holds one group and
    one Arrow batch, however many groups it has.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        key: tuple | None = None
        for some in it:
            out: list[tuple] = []
            for row in some.itertuples(index=False):
                own = tuple(None if pd.isna(v := getattr(row, k)) else v for k in keys)  # null is a key like any other
                if own != key and held:
                    out += work(held)
                    held = []
                key = own
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(work(held), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
