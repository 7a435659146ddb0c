"""Operator 7. Packing of token pieces into sequences: Martello-Toth dominance, then best fit."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hold, parts, table
from .tokens import encoder, slices

CAPACITY, END_ID = 2048, 0
#: Words kept by a worker: fewer than the tokenizer's own limit, since in the pipeline the executor's memory is full from the stages before.
WORDS = 700_000
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: A pattern: the lengths of one sequence and how many each, and the number of sequences that look so.
Pattern = tuple[dict[int, int], int]


def _pieces(it: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    hold("tokens", encoder.cache_clear)
    enc = encoder(path, WORDS)
    for batch in it:
        own = batch.column("doc_id").to_pylist()
        for k, texts in slices(batch):
            rows: list[tuple] = []
            ids, ends = enc.encode(texts, END_ID)
            data, first = memoryview(ids.tobytes()), 0
            for key, last in zip(own[k:], ends.tolist(), strict=False):
                n, start, piece = last - first, 0, 0
                size = n % capacity or min(n, capacity)
                while start < n:
                    at = first + start
                    rows.append((key, piece, start, size, zlib.crc32(data[4 * at : 4 * (at + size)])))
                    start, piece, size = start + size, piece + 1, capacity
                first = last
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: ids of the whole text and END_ID, cut only when longer than capacity; the first piece may be shorter."""
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(lambda it: _pieces(it, tokenizer, capacity), PIECES_SCHEMA)


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth reduction: (sequences fixed for good, the pieces left).

    For the longest piece x with room r left beside it, a set that dominates all others with x is fixed: x alone if
    nothing fits; x and y where y fills r; x and the longest fitting y where no two or more pieces sum to more than y
    and at most r, for then whatever lies beside x elsewhere can change places with y; x with y and the longest z that
    fits beside both, where no three fit beside x and of any two that fit the shorter is at most z. Sets of three and
    more beside x are only ruled out by size. All copies are fixed at once. Repeats until nothing can be fixed, since
    each fix makes the instance smaller.
    """
    left, fixed = Counter({k: n for k, n in counts.items() if n}), []
    more = True
    while more:
        more = False
        for x in sorted(left, reverse=True):
            while left[x]:
                room = capacity - x
                fits = sorted(k for k in left if k <= room and left[k] - (k == x) > 0)
                if not fits:
                    sets, n = {x: 1}, left[x]
                else:
                    y = fits[-1]
                    if y == room or _only(left, fits, x, y, room):
                        sets = Counter([x, y])
                    elif z := _pair(left, fits, x, y, room):
                        sets = Counter([x, y, z])
                    else:
                        break
                    n = min(left[k] // m for k, m in sets.items())
                for k, m in sets.items():
                    left[k] -= m * n
                fixed.append((sets, n))
                more = True
            if not left[x]:
                del left[x]
    return fixed, {k: n for k, n in left.items() if n}


def _only(left: Counter, fits: list[int], x: int, y: int, room: int) -> bool:
    """No two or more pieces beside x have a sum above y and at most room."""
    if 3 * fits[0] <= room:
        return False
    lo, hi = 0, len(fits) - 1
    while lo <= hi:  # the largest sum of two within room
        a, b = fits[lo], fits[hi]
        if a + b > room:
            hi -= 1
        elif a != b or left[a] - (a == x) > 1:
            if a + b > y:
                return False
            lo += 1
        else:
            lo += 1
    return True


def _pair(left: Counter, fits: list[int], x: int, y: int, room: int) -> int:
    """The piece z that with y dominates all that fits beside x, or 0."""
    free = Counter({k: left[k] - (k == x) for k in fits})
    shortest = [k for k in fits[:3] for _ in range(min(3, free[k]))][:3]
    if len(shortest) == 3 and sum(shortest) <= room:
        return 0
    z = max((k for k in fits if k + y <= room and free[k] > (k == y)), default=0)
    above = [k for k in fits if k > z for _ in range(min(2, free[k]))][:2]
    return z if z and (len(above) < 2 or sum(above) > room) else 0


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing over the histogram of lengths: pieces of a length and sequences of a look are moved together."""
    open_: dict[int, list[Pattern]] = {}
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_ if r >= size), default=capacity)
            look, have = open_[room].pop() if room in open_ else ({}, n)
            if room in open_ and not open_[room]:
                del open_[room]
            each = room // size
            full = min(have, n // each)
            rest = min(n - full * each, each - 1) if full < have else 0
            for m, k in ((each, full), (rest, 1 if rest else 0)):
                if k:
                    open_.setdefault(room - m * size, []).append((look | {size: look.get(size, 0) + m}, k))
            spare = have - full - (1 if rest else 0)
            if spare and look:
                open_.setdefault(room, []).append((look, spare))
            n -= full * each + rest
    return [p for group in open_.values() for p in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Slots:
    """Where the piece of a length and rank goes: per length, ranges of ranks in order."""

    def __init__(self, patterns: list[Pattern]):
        self.by: dict[int, list[tuple[int, int, int, int]]] = {}  # length: (first rank, first sequence, pieces a sequence, place of the first)
        upto: Counter = Counter()
        base = 0
        for look, n in patterns:
            place = 0
            for size in sorted(look, reverse=True):
                self.by.setdefault(size, []).append((upto[size], base, look[size], place))
                upto[size] += look[size] * n
                place += size * look[size]
            base += n
        self.by = {k: np.array(v, np.int64) for k, v in self.by.items()}

    def place(self, length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            ranges = self.by[int(s)]
            k = ranges[np.searchsorted(ranges[:, 0], rank[at], "right") - 1]
            here = rank[at] - k[:, 0]
            sequence[at] = k[:, 1] + here // k[:, 2]
            offset[at] = k[:, 3] + here % k[:, 2] * s
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset, in as few sequences as the plan finds.

    The plan needs only how many pieces there are of each length, at most `capacity` numbers, so the driver makes it
    at any size of the input. Null texts are documents of END_ID alone; texts of any length are cut into pieces. A piece learns its place from its rank among those of its length: its rank in a bucket
    and the sums of the buckets before. A length that many pieces share is spread over all buckets. Empty input gives
    no rows; repeated rows are pieces of their own.
    """
    spark = pieces.sparkSession
    n = parts(spark)
    dealt = cut(pieces.withColumn("bucket", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "length"]), F.lit(n))))
    heaps = cut(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in heaps.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(plan(counts, capacity))
    before = heaps.select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = [c for c in pieces.columns if c != "length"]
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)).cast("long") - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("before") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return slots.place(length, rank)

    return ranked.withColumn("to", place("length", "rank")).select(*pieces.columns, "to.sequence_id", "to.offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
