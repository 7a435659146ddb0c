"""Operator 8. Near-duplicates by SimHash, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, hold, keep_only, parts, table
from .tokens import batches

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints that share a 16-bit block and number more than this are parted once more by the bits that are left.
HOT_BLOCK = 200_000
LEAF, FAN = 8, 8
#: Node pairs that are widened at once, and fingerprints that are indexed at once (but whole blocks).
STEP, HELD = 20_000, 200_000


def fingerprints(texts: list[str], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text over word shingles; zero where there is no word."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    hashes: list[np.ndarray] = []
    for text in texts:
        w = text.encode().lower().split()  # of bytes: A-Z only, and white space is 20 and 09 to 0D
        grams = [b" ".join(w)] if 0 < len(w) < shingle else map(b" ".join, zip(*[w[k:] for k in range(shingle)], strict=False))
        hashes.append(np.fromiter(map(digest, grams), np.uint64))
    return majorities(hashes)


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the bits that are set in over half of them."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        data, starts = np.concatenate(hashes), (np.cumsum(sizes) - sizes)[some]
        bits = np.unpackbits(data.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(counts * 2 > sizes[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of x in the reflected Gray sequence, in which neighbours differ by one bit."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Fingerprints of several blocks, each block a tree: sorted by Gray rank, runs of LEAF make leaves, runs of FAN nodes the next level.

    A node has the bits that all fingerprints below it share, as mask and pattern; what two nodes differ in on the bits
    that both share is the least that any two fingerprints below them differ in, and grows on the way down.
    """

    def __init__(self, block: np.ndarray, prints: np.ndarray):
        self.order = np.lexsort((gray_rank(prints), block))
        self.x, b = prints[self.order], block[self.order]
        lo, hi, first = self.x, self.x, np.arange(len(b))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = LEAF
        while True:
            new = np.concatenate([[True], b[1:] != b[:-1]])
            start = np.flatnonzero(new)
            inside = np.arange(len(b)) - np.repeat(start, np.diff(start, append=len(b)))
            first = np.flatnonzero(inside % size == 0)
            lo, hi = np.bitwise_and.reduceat(lo, first), np.bitwise_or.reduceat(hi, first)
            mask = ~(lo ^ hi)
            self.levels.append((first, np.append(first[1:], len(b)), mask, lo & mask))
            b, size = b[first], FAN
            if not (b[1:] == b[:-1]).any():
                break

    def pairs(self, distance: int, skip=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (i, j) of places in x, of one block, that differ in at most `distance` bits. skip(a, b) tells which pairs of leaves need no look."""
        roots = np.arange(len(self.levels[-1][0]))
        todo = [(len(self.levels) - 1, roots, roots)]
        while todo:
            level, a, b = todo.pop()
            if len(a) > STEP:
                todo += [(level, a[k : k + STEP], b[k : k + STEP]) for k in range(0, len(a), STEP)]
                continue
            if level == 0 and skip is not None:
                look = ~skip(a, b)
                a, b = a[look], b[look]
            start, end = self.levels[level][:2]
            na, nb = end[a] - start[a], end[b] - start[b]
            of = np.repeat(np.arange(len(a)), na * nb)
            k = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            ca, cb = start[a][of] + k // nb[of], start[b][of] + k % nb[of]
            if level:
                own = ca <= cb
                ca, cb = ca[own], cb[own]
                mask, pattern = self.levels[level - 1][2:]
                near = np.bitwise_count((pattern[ca] ^ pattern[cb]) & mask[ca] & mask[cb]) <= distance
                if near.any():
                    todo.append((level - 1, ca[near], cb[near]))
            else:
                own = ca < cb
                ca, cb = ca[own], cb[own]
                near = np.bitwise_count(self.x[ca] ^ self.x[cb]) <= distance
                if near.any():
                    yield ca[near], cb[near]


def roots_of(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while not np.array_equal(up := parent[r], r):
        r = up
    return r


def link(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; a root is the smallest of its set."""
    while len(i):
        a, b = roots_of(parent, i), roots_of(parent, j)
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def block_links(block: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): for each fingerprint that reaches a smaller place in its block, itself and the first one that it reaches."""
    index = GrayIndex(block, prints)
    parent = np.arange(len(prints))
    first = index.levels[0][0]

    def skip(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parent[:] = roots_of(parent, parent)
        low, high = np.minimum.reduceat(parent, first), np.maximum.reduceat(parent, first)
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])

    for i, j in index.pairs(distance, skip):
        link(parent, i, j)
    r = roots_of(parent, np.arange(len(prints)))
    moved = np.flatnonzero(r != np.arange(len(prints)))
    return index.x[moved], index.x[r[moved]]


def _links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by block; blocks are indexed together while they are small."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(block: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        u, v = block_links(np.cumsum(np.concatenate([[0], block[1:] != block[:-1]])), prints)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in it:
        held.append((batch.column("block").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
        if sum(len(b) for b, _ in held) >= HELD:
            block, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            end = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
            held = [(block[end:], prints[end:])]
            if end:
                yield out(block[:end], prints[:end])
    if held and len(held[0][0]) + sum(len(b) for b, _ in held[1:]):
        yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_links(prints: DataFrame) -> DataFrame:
    """(u, v) links that join distinct fingerprints fp of at most DISTANCE differing bits into their components; in number below 16 a fingerprint.

    Of four 16-bit blocks two such fingerprints have one alike, so a fingerprint goes to four blocks. A block with more
    than HOT_BLOCK of them is parted by four 12-bit blocks of the other bits, of which again one is alike.
    """
    if DISTANCE != 3:
        raise ValueError("four blocks find distances up to 3")
    bits = lambda x, at, n: F.shiftrightunsigned(x, at).bitwiseAND((1 << n) - 1)
    fp = F.col("fp")
    rest = lambda k: fp.bitwiseAND(_long(~(0xFFFF << (16 * k))))
    squeezed = lambda k: F.shiftleft(F.shiftrightunsigned(rest(k), 16 * (k + 1)) if k < 3 else F.lit(0).cast("long"), 16 * k).bitwiseOR(rest(k).bitwiseAND(_long((1 << (16 * k)) - 1)))
    blocks = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), bits(fp, 16 * k, 16).alias("value"), squeezed(k).alias("rest")) for k in range(4)])).alias("b")).select("fp", "b.*")
    hot = blocks.groupBy("k", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BLOCK).select("k", "value", F.lit(True).alias("hot"))
    finer = F.array(*[F.struct(F.lit(j).alias("j"), bits(F.col("rest"), 12 * j, 12).alias("more")) for j in range(4)])
    whole = F.array(F.struct(F.lit(4).alias("j"), F.lit(0).cast("long").alias("more")))
    dealt = blocks.join(F.broadcast(hot), ["k", "value"], "left").select("fp", "k", "value", F.explode(F.when(F.col("hot"), finer).otherwise(whole)).alias("m"))
    block = F.col("k") + 4 * (F.col("m.j") + 5 * (F.col("m.more") + 4096 * F.col("value")))
    dealt = dealt.select("fp", block.cast("long").alias("block")).repartition(parts(prints.sparkSession), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(_links, "u long, v long")


def _long(x: int) -> Column:
    x &= 0xFFFFFFFFFFFFFFFF
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _print(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("simhash")
    for batch in it:
        ids = batch.column("doc_id")
        for k, texts in batches(batch):
            yield pa.RecordBatch.from_arrays([ids.slice(k, len(texts)), batch.column("text_hash").slice(k, len(texts)), pa.array(fingerprints(texts).view(np.int64))], ["doc_id", "text_hash", "fp"])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach), text_hash, group (a fingerprint, alike for a component).

    Equal fingerprints are one node, so copies never make pairs. Null and empty texts have fingerprint zero, and link
    like any other. Null ids are left out of the smallest; a component of null ids only has a null one. Repeated rows
    each get their row, an empty table gives none, other columns are not read.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    prints = cut(base.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_print, "doc_id long, text_hash long, fp long"))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = cut(connected_components(near_links(nodes.select("fp"))))
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = named.join(ids, "component").select("fp", "component_id", "component")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", F.col("component").alias("group"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, the one with the smallest id (null ids last; of one id the smallest hash of the text); all columns stay."""
    return keep_first(docs, simhash_groups(docs, id_col, text_col), id_col, text_col)


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each group of rows(doc_id, text_hash, group)."""
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("text_hash").alias("key"))
    copies = rows.groupBy("group", first.alias("first")).agg(F.count("*").alias("n"))
    keepers = copies.groupBy("group").agg(F.min(F.struct("first", "n")).alias("m")).select("m.first.doc_id", "m.first.key", "m.n")
    return keep_only(docs, keepers, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))), id_col)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
