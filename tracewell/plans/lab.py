"""Operations around stored runs: who may ask, costs, rebuilding an extraction from its cells, what became of each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canon


def guard(request: Column, hosts: list[str], token: str | None = None) -> Column:
    """The status that a request is turned away with, or null: 421 for another host, 403 for another origin, 401 for a wrong token. request: struct(host, origin, token)."""
    bare = lambda h: F.lower(F.regexp_replace(h, r":\d+$", ""))
    origin = F.regexp_extract(F.coalesce(request["origin"], F.lit("")), r"^[a-z]+://([^/]+)", 1)
    known = [h.lower() for h in hosts]
    host = F.coalesce(bare(request["host"]).isin(known), F.lit(False))
    foreign = (F.coalesce(request["origin"], F.lit("")) != "") & ~bare(origin).isin(known)
    wrong = F.lit(False) if token is None else ~request["token"].eqNullSafe(F.lit(token))
    return F.when(~host, 421).when(foreign, 403).when(wrong, 401)


def repin(cells: DataFrame) -> DataFrame:
    """The extraction that flat names stand for: doc_id, extraction (JSON).

    cells: doc_id, name, value. `name[i].col` is a column of the i-th object of a list, `name[i]` the i-th of a list,
    anything else a field. Lists are in order of i; null values stay.
    """
    part = lambda k: F.regexp_extract("name", r"^(.*?)\[(\d+)\](?:\.(.+))?$", k)
    split = cells.select("doc_id", "value", F.when(part(1) != "", part(1)).otherwise(F.col("name")).alias("top"), part(2).try_cast("int").alias("i"), part(3).alias("col"))
    text = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    quoted = lambda c: text(F.col(c))
    items = split.where("i is not null").groupBy("doc_id", "top", "i").agg(
        F.array_sort(F.collect_list(F.when(F.col("col") != "", F.struct("col", quoted("value").alias("v"))))).alias("cols"), F.first(F.when(F.col("col") == "", quoted("value")), ignorenulls=True).alias("one")
    )
    object_ = F.concat(F.lit("{"), F.array_join(F.transform("cols", lambda c: F.concat(text(c["col"]), F.lit(":"), c["v"])), ","), F.lit("}"))
    items = items.select("doc_id", "top", "i", F.when(F.size("cols") > 0, object_).otherwise(F.coalesce("one", F.lit("null"))).alias("json"))
    lists = items.groupBy("doc_id", "top").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "json"))), lambda x: x["json"]), ","), F.lit("]")).alias("json"))
    plain = split.where("i is null").groupBy("doc_id", "top").agg(F.first(quoted("value")).alias("json"))
    fields = lists.unionByName(plain)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "json"))), lambda x: F.concat(text(x["top"]), F.lit(":"), x["json"])), ",")
    return fields.groupBy("doc_id").agg(F.concat(F.lit("{"), body, F.lit("}")).alias("extraction"))


def priced(usage: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """usage(model, tokens_in, tokens_out, ...) with usd: prices(model, usd_in, usd_out) for a million tokens, aliases(model, means); null for a model without a price."""
    named = usage.join(F.broadcast(aliases), "model", "left").withColumn("priced_as", F.coalesce("means", "model")).drop("means")
    p = F.broadcast(prices.select(F.col("model").alias("priced_as"), "usd_in", "usd_out"))
    usd = F.round((F.col("usd_in") * F.col("tokens_in") + F.col("usd_out") * F.col("tokens_out")) / 1e6, 5)
    return named.join(p, "priced_as", "left").withColumn("usd", usd).drop("priced_as", "usd_in", "usd_out")


def read_rates(verdicts: DataFrame, *by: str) -> DataFrame:
    """Per key: fields, how many were read, missed, invented, absent or unclear, and the shares read of all present and of all asserted."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    read, missed, invented, unclear = n("read"), n("missed"), n("invented"), n("unclear")
    rate = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return verdicts.groupBy(*by).agg(F.count("*").alias("n"), read.alias("n_read"), missed.alias("n_missed"), invented.alias("n_invented"), n("absent").alias("n_absent"), unclear.alias("n_unclear"), rate(read, read + missed + unclear).alias("recall"), rate(read, read + invented + unclear).alias("precision"))


def agree_rates(values: DataFrame, *by: str) -> DataFrame:
    """Per key the share of fields on which two and more models agree by canonical form: values(field, model, value)."""
    c = F.when(F.col("value").isNotNull(), canon(F.col("value")))
    per = values.groupBy(*by, "field").agg(F.count_distinct("model").alias("m"), F.count_distinct(c).alias("v")).where("m >= 2")
    return per.groupBy(*by).agg(F.count("*").alias("n_fields"), F.round(F.avg((F.col("v") <= 1).cast("double")), 6).alias("agree_rate"))
