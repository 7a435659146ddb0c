"""Tables that are changed by key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys; columns and their order are old's. Null keys are equal."""
    known = new.select(*[new[k].alias(f"__new_{k}") for k in keys]).distinct()
    same = [old[k].eqNullSafe(known[f"__new_{k}"]) for k in keys]
    return old.join(known, same, "left_anti").unionByName(new.select(old.columns))


def upsert_partitions(old: DataFrame, new: DataFrame, keys: list[str], path: str, by: str) -> None:
    """Write upserted() over the partitions that new touches, and no others."""
    touched = old.join(new.select(by).distinct(), by, "left_semi")
    upserted(touched, new, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
