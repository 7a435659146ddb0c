"""Operator 1. Token ids of whole documents in shards compressed by a Re-Pair grammar."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold, parts, scratch, table
from .tokens import encoder, slices

END_ID = 2
#: Ids of a shard, at least; a shard ends with a document.
SHARD_IDS = 1_000_000
RULES_A_ROUND, LEAST_COUNT = 16384, 8
_BITS = 19
#: Places of shards beyond so many are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000

FILE_SCHEMA = "part int, shard int, n_docs int, n_ids long, doc_ids binary, no_id binary, doc_symbols binary, first_rule long, rules binary, rule_lengths binary, symbols binary"
OUT_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def compress(ids: np.ndarray, doc_sizes: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, doc_symbols): Re-Pair in rounds. Each round counts all pairs of neighbours and replaces the frequent ones by new nonterminals, until no pair occurs LEAST_COUNT times.

    Where chosen pairs overlap, every second of a run is taken from its left. No pair reaches over a document's end,
    so a document is a slice of the symbols. Rules of a round stand for symbols of earlier rounds only.
    """
    symbols, rules, sizes = ids.astype(np.int64), [], doc_sizes.astype(np.int64)
    known: dict[int, int] = {}
    while len(symbols) > 1:
        pairs = symbols[:-1] << 32 | symbols[1:]
        slot = _slot(pairs)
        slot[np.cumsum(sizes)[:-1] - 1] = 1 << _BITS  # no pair over a document's end
        counts = np.bincount(slot, minlength=(1 << _BITS) + 1)
        counts[-1] = 0
        # a pair is no more frequent than its slot; those in frequent slots are counted themselves
        at = np.flatnonzero((counts >= LEAST_COUNT)[slot])
        ordered = np.sort(pairs[at])
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), ordered[1:] != ordered[:-1]]))
        n = np.diff(starts, append=len(ordered))
        order = np.flatnonzero(n >= LEAST_COUNT)
        if not len(order):
            break
        chosen = ordered[starts[order[np.argsort(-n[order], kind="stable")[:RULES_A_ROUND]]]]
        # of chosen pairs in one slot the most frequent is replaced now, the others in a later round
        by_slot = np.zeros((1 << _BITS) + 1, np.int32)
        by_slot[_slot(chosen[::-1])] = np.arange(len(chosen))[::-1]
        place = by_slot[slot[at]]
        own = chosen[place] == pairs[at]
        at, place = at[own], place[own]
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        run = np.repeat(starts, np.diff(starts, append=len(at)))
        take = (np.arange(len(at)) - run) & 1 == 0
        at, place = at[take], place[take]
        number = np.zeros(len(chosen), np.int64)
        for k in np.flatnonzero(np.bincount(place, minlength=len(chosen))).tolist():  # overlaps may have left a pair for a later round
            pair = int(chosen[k])
            if pair not in known:
                known[pair] = first_rule + len(rules)
                rules.append((pair >> 32, pair & 0xFFFFFFFF))
            number[k] = known[pair]
        named = number[place]
        symbols[at] = named
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        sizes = sizes - np.diff(np.searchsorted(at + 1, np.cumsum(sizes)), prepend=0)
        symbols = symbols[keep]
    return symbols.astype("<u4"), np.array(rules, "<u4").reshape(-1, 2), sizes.astype("<u4")


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first_rule] if a >= first_rule else 1) + (out[b - first_rule] if b >= first_rule else 1))
    return np.array(out, "<u8")


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.int64)
    while len(at := np.flatnonzero(symbols >= first_rule)):
        pair = rules[symbols[at] - first_rule]
        sizes = np.ones(len(symbols), np.int64)
        sizes[at] = 2
        to = np.cumsum(sizes)[at] - 2
        symbols = np.repeat(symbols, sizes)
        symbols[to], symbols[to + 1] = pair[:, 0], pair[:, 1]
    return symbols.astype("<u4")


def read_document(row, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard's row; only its own symbols are expanded."""
    ends = np.cumsum(np.frombuffer(row["doc_symbols"], "<u4"), dtype=np.int64)
    own = np.frombuffer(row["symbols"], "<u4")[ends[k - 1] if k else 0 : ends[k]]
    return expand(own, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), row["first_rule"])


def _shards(it: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    hold("tokens", encoder.cache_clear)
    enc, part, shard = encoder(path), TaskContext.get().partitionId(), 0
    keys: list[int | None] = []
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def close() -> pa.RecordBatch:
        first_rule = max(enc.vocab_size, END_ID + 1)
        symbols, rules, doc_symbols = compress(np.concatenate(ids), np.concatenate(sizes), first_rule)
        row = {
            "part": part, "shard": shard, "n_docs": len(keys), "n_ids": held, "doc_ids": np.array([k or 0 for k in keys], "<i8").tobytes(), "no_id": np.array([k is None for k in keys], "u1").tobytes(),
            "doc_symbols": doc_symbols.tobytes(), "first_rule": first_rule, "rules": rules.tobytes(), "rule_lengths": rule_lengths(rules, first_rule).tobytes(), "symbols": symbols.tobytes(),
        }
        keys.clear(), ids.clear(), sizes.clear()
        kinds = {"part": pa.int32(), "shard": pa.int32(), "n_docs": pa.int32(), "n_ids": pa.int64(), "first_rule": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))

    for batch in it:
        own = batch.column("doc_id").to_pylist()
        for k, texts in slices(batch):
            data, ends = enc.encode(texts, END_ID)
            first = 0  # document of the slice
            while first < len(ends):
                before = ends[first - 1] if first else 0
                last = min(len(ends), int(np.searchsorted(ends, before + SHARD_IDS - held)) + 1)
                keys += own[k + first : k + last]
                ids.append(data[before : ends[last - 1]])
                sizes.append(np.diff(ends[first:last], prepend=before))
                held += int(ends[last - 1] - before)
                first = last
                if held >= SHARD_IDS:
                    yield close()
                    shard, held = shard + 1, 0
    if keys:
        yield close()


def write_shards(docs: DataFrame, to: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole documents, end each with END_ID, and write them in ascending doc_id order to Parquet files at `to`, a row a shard.

    A row holds: part and shard (their order is the documents'), the documents' ids, the number of symbols of each
    document, the grammar's rules as pairs, the number of ids each rule stands for, and the symbols; all arrays
    little-endian. Null ids come first; equal ids stand in the order of a hash of their texts. Null is the empty text.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = base.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(lambda it: _shards(it, tokenizer), FILE_SCHEMA).write.option("compression", "zstd").parquet(to)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`: the ids of all shards before."""
    shards = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = sizes.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("inside"))
    starts = within.join(totals, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("start"))
    few = starts.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    return shards.join(F.broadcast(starts) if few else starts, ["part", "shard"])


def _documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for row in batch.to_pylist():
            ids = expand(np.frombuffer(row["symbols"], "<u4"), rules := np.frombuffer(row["rules"], "<u4").reshape(-1, 2), row["first_rule"])
            lengths = np.concatenate([np.ones(row["first_rule"], np.int64), np.frombuffer(row["rule_lengths"], "<u8").astype(np.int64)]) if len(rules) else None
            symbols = np.frombuffer(row["symbols"], "<u4")
            upto = np.concatenate([[0], np.cumsum(lengths[symbols] if lengths is not None else np.ones(len(symbols), np.int64))])
            ends = upto[np.cumsum(np.frombuffer(row["doc_symbols"], "<u4"), dtype=np.int64)]
            starts = np.concatenate([[0], ends[:-1]])
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            keys = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["no_id"], "u1").astype(bool))
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32 of its decoded ids. No files' rows, no documents."""
    return read_shards(spark, path).mapInArrow(_documents, OUT_SCHEMA)


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = scratch(spark, "repair")
    write_shards(table(spark, sf_dir, "documents"), to, public_tokenizers.path("byte_bpe_50k.json"))
    return document_index(spark, to)
