"""Near copies by the Jaccard similarity of their word shingles, found by SimHash's Gray-order index and, where that misses some, exactly by a prefix filter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, hold, parts, written
from .simhash import SEED, keep_first, link, majorities, near_links, roots_of
from .tokens import batches

#: Words of a shingle; similarity, as a fraction, from which texts are near copies.
SHINGLE, ALIKE, OF = 5, 4, 5
#: Of each SAMPLE texts one is read for common shingles: those that LEAST of them have, the COMMON most frequent at most. Which ones are found changes the work, never the result.
SAMPLE, LEAST, COMMON = 16, 4, 1_000_000
#: Rows of a partition that are looked at together (but whole buckets), and pairs of rows.
HELD, STEP = 200_000, 2_000_000

#: Bits of the smallest sketch. Rows of a bucket above which its smallest node's buckets are dealt in SLICES. Rounds of _crossings that look for links first.
BITS, WIDE, SLICES, FORESTS = 512, 256, 64, 1
#: Up to so many texts are fetched by a broadcast of their hashes; for more, all texts are shuffled.
FEW = 300_000

#: More than any sets share: a pair that is looked at in any case.
LOOK = 1 << 40
PAIRS = "u long, v long, shared long, due long"
#: Rows (h, node, n, pos) and pairs (u, v, shared, due) in one table.
FIRST_PASS = "pair boolean, a long, b long, c long, d long"
#: Rows of torn buckets; _crossings reads each key's with (member true) the size, component and sketch of each node among them.
TORN = "key long, h long, node long, n long, pos long"


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each text's word shingles, ascending; a shorter text is one shingle, and one without a word has none."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    out = []
    for text in texts:
        w = text.encode().lower().split()
        grams = [b" ".join(w)] if 0 < len(w) < shingle else map(b" ".join, zip(*[w[k:] for k in range(shingle)], strict=False))
        out.append(np.unique(np.fromiter(map(digest, grams), np.uint64)))
    return out


def due(n):
    """How many shingles the prefixes of two sets share at least if the sets are alike, n the size of the smaller: with those of a common line only, they don't."""
    return np.minimum(-(ALIKE * n // -OF), 8 + n // 32)


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first of a set, in an order alike for all sets (common ones last), that hold due() of those that it shares with any set of similarity ALIKE / OF or more."""
    if len(common) and len(own):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        hot = common[at] == own
        own = np.concatenate([own[~hot], own[hot]])
    return own[: len(own) + (ALIKE * len(own) // -OF) + int(due(len(own)))]


def possible(na, pa_, nb, pb):
    """Whether sets of these sizes can be so alike, if they share what stands at these places of theirs."""
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    return (OF * np.minimum(na, nb) >= ALIKE * np.maximum(na, nb)) & (most * (ALIKE + OF) >= ALIKE * (na + nb))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * OF >= ALIKE * (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> np.ndarray:
    """Bits, as words, each set if an odd number of the set's shingles fall on it: two sets differ in at least as many shingles as their sketches in bits. As many bits as shingles, a power of two."""
    bits = max(BITS, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The smaller sketch, of `size` words, of the same set (or of the same sets, a row each)."""
    while words.shape[-1] > size:
        words = words[..., : words.shape[-1] // 2] ^ words[..., words.shape[-1] // 2 :]
    return words


def near_enough(na, nb, differ):
    """Whether sets of these sizes can be alike if they differ in so many shingles."""
    return differ * (ALIKE + OF) <= (OF - ALIKE) * (na + nb)


class Sketches:
    """The sketches of some nodes, side by side with those of the same size and, folded, of twice that: sets that can be alike have no others."""

    def __init__(self, words: list[np.ndarray]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.zeros((2, len(words)), np.int64)
        self.tables: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            own, twice = np.flatnonzero(self.size == size), np.flatnonzero(self.size == 2 * size)
            self.at[0, own], self.at[1, twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            self.tables[size] = np.stack([folded(words[k], size) for k in (*own, *twice)])

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of these differ, at the size of the smaller; 0 where one has over twice the other's size."""
        small, out = np.minimum(self.size[i], self.size[j]), np.zeros(len(i), np.int64)
        fit = np.maximum(self.size[i], self.size[j]) <= 2 * small
        for size, table in self.tables.items():
            here = np.flatnonzero((small == size) & fit)
            step = max(1, STEP // size)
            for k in range(0, len(here), step):
                x = here[k : k + step]
                a, b = (table[self.at[(self.size[y[x]] != size).astype(np.int64), y[x]]] for y in (i, j))
                out[x] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        return out


def forest(a: np.ndarray, b: np.ndarray, far: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Places of pairs (a, b) that join the components comp of all a and b with the nearest pairs: fewer than there are components."""
    order = np.argsort(far, kind="stable")
    names, x = np.unique(np.concatenate([comp[a[order]], comp[b[order]]]), return_inverse=True)
    x, y = x[: len(a)], x[len(a) :]
    parent, live, out = np.arange(len(names)), np.arange(len(a)), []
    while True:
        u, v = roots_of(parent, x[live]), roots_of(parent, y[live])
        differ = u != v
        live, u, v = live[differ], u[differ], v[differ]
        if not len(live):
            return order[np.concatenate(out)] if out else np.zeros(0, np.int64)
        best = np.full(len(names), len(a))
        np.minimum.at(best, u, live)
        np.minimum.at(best, v, live)
        best = np.unique(best[best < len(a)])
        link(parent, x[best], y[best])
        out.append(best)


def _buckets(it: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches come sorted by h: their columns, whole buckets together while they are small."""
    held: list[list[np.ndarray]] = []
    for batch in it:
        held.append([c.to_numpy() for c in batch.columns])
        if sum(len(x[0]) for x in held) >= HELD:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1 if cols[0][0] != cols[0][-1] else 0
            held = [[c[end:] for c in cols]]
            if end:
                yield [c[:end] for c in cols]
    if held and sum(len(x[0]) for x in held):
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _pairs(u: np.ndarray, v: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """Each pair once, with the number of its buckets and how many they must be."""
    both, at, n = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n), pa.array(least[at])], ["u", "v", "shared", "due"])


def _shared_and_stars(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of buckets of several rows the rows (pair false), and the pairs of each row with its bucket's smallest node (pair true)."""
    names = [c.split()[0] for c in FIRST_PASS.split(", ")]
    for h, node, n, pos in _buckets(it):
        order = np.lexsort((node, h))
        h, node, n, pos = h[order], node[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        new = np.concatenate([[True], h[1:] != h[:-1]])
        alone = new & np.append(new[1:], True)
        h, node, n, pos = h[~alone], node[~alone], n[~alone], pos[~alone]
        if not len(h):
            continue
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), bool)), *map(pa.array, (h, node, n, pos))], names)
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        c = np.repeat(start, np.diff(start, append=len(h)))
        look = (node != node[c]) & possible(n, pos, n[c], pos[c])
        pairs = _pairs(node[look], node[c][look], due(np.minimum(n, n[c])[look]))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(pairs.num_rows, bool)), *pairs.columns], names)


def _torn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets whose rows' components differ. A bucket's key is its smallest node, so that buckets of nearly the same nodes meet; those of many rows are dealt by their shingle too."""
    for h, node, n, pos, comp in _buckets(it):
        order = np.lexsort((comp, h))
        h, node, n, pos, comp = h[order], node[order], n[order], pos[order], comp[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        end = np.append(start[1:], len(h))
        torn = np.repeat(comp[start] != comp[end - 1], end - start)
        key = np.minimum.reduceat(node, start) ^ np.where(end - start > WIDE, (h[start] % SLICES + 1) << 48, 0)
        cols = np.repeat(key, end - start), h, node, n, pos
        yield pa.RecordBatch.from_arrays([pa.array(c[torn]) for c in cols], [c.split()[0] for c in TORN.split(", ")])


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches come sorted by key: whole keys together while they are small."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        held.append(batch)
        if sum(map(len, held)) >= HELD:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            held = t.slice(end).to_batches()
            if end:
                yield t.slice(0, end)
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _crossings(it: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """Of each bucket the pairs of rows whose components differ and that their sketches let be alike; at first only the nearest of them that join these components, which are fewer than the rows."""
    for t in _keys(it):
        members = t.filter(t.column("member"))
        nodes, at = np.unique(members.column("node").to_numpy(), return_index=True)
        if not len(nodes):
            continue
        size, own = members.column("n").to_numpy()[at], members.column("comp").to_numpy()[at]
        sketches = Sketches([np.frombuffer(x.as_buffer(), np.uint64) for x in members.column("sketch").take(pa.array(at))])
        h, node, pos, is_row = (t.column(c).to_numpy() for c in ("h", "node", "pos", "member"))
        x = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
        is_row = ~is_row & (nodes[x] == node)
        h, x, pos = h[is_row], x[is_row], pos[is_row]
        order = np.lexsort((own[x], h))
        h, x, pos = h[order], x[order], pos[order]
        n, comp = size[x], own[x]
        # each row is held against the bucket's rows after its own component; rows of a component stand together
        new = (h[1:] != h[:-1]).nonzero()[0] + 1
        end = np.append(new, len(h))[np.searchsorted(new, np.arange(len(h)), "right")]
        last = np.append(np.flatnonzero((h[1:] != h[:-1]) | (comp[1:] != comp[:-1])) + 1, len(h))
        after = last[np.searchsorted(last[:-1], np.arange(len(h)), "right")]
        upto, k = np.concatenate([[0], np.cumsum(end - after)]), 0
        while k < len(h):
            to = max(k + 1, int(np.searchsorted(upto, upto[k] + STEP, "right")) - 1)
            i = np.repeat(np.arange(k, to), (end - after)[k:to])
            j = np.arange(len(i)) - (upto[i] - upto[k]) + after[i]
            good = possible(n[i], pos[i], n[j], pos[j])
            i, j = x[i[good]], x[j[good]]
            pair, shared = np.unique(np.minimum(i, j) * len(nodes) + np.maximum(i, j), return_counts=True)
            i, j = pair // len(nodes), pair % len(nodes)
            far = sketches.differ(i, j)
            good = near_enough(size[i], size[j], far)
            i, j, far, shared = i[good], j[good], far[good], shared[good]
            must = due(np.minimum(size[i], size[j]))
            if first:
                near = forest(i, j, far / (size[i] + size[j]), own)
                i, j, shared, must = i[near], j[near], np.full(len(near), LOOK), np.zeros(len(near), np.int64)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes[i], nodes[j], shared, must)], ["u", "v", "shared", "due"])
            k = to


def _near_enough(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        na, nb = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
        differ = []
        for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            size = min(len(x), len(y))
            differ.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()))
        yield batch.select(["u", "v"]).filter(pa.array(near_enough(na, nb, np.array(differ, np.int64)), pa.bool_()))


def _verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        a, b = batch.column("a"), batch.column("b")
        good = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(a, b, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def close_pairs(prints: DataFrame) -> DataFrame:
    """Of prints(node, fp) the pairs that operator 8 links: nodes whose fingerprints its Gray-order index joins, each with the smallest node of its fingerprint, and these."""
    nodes = prints.select("node", "fp").distinct()
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    links = near_links(first.select("fp"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    across = links.distinct().join(of("u"), "u").join(of("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    pairs = nodes.join(first, "fp").select(F.col("node").alias("u"), F.col("first").alias("v")).unionByName(across)
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text_hash, group, alike for texts that links of similarity ALIKE / OF or more of their sets of SHINGLE-word shingles join.

    Sets whose SimHash fingerprints operator 8's index links are looked at first; it finds few of such pairs, most of
    which differ in more bits. Two such sets share due() of their prefixes' shingles; rows of a shared shingle are a
    bucket. Its rows are held against its smallest one first. Those that these steps leave in different components are
    held against each other by their sketches, which tell exactly of most pairs that they aren't alike; of the others
    FORESTS rounds return those that join the bucket's components, fewer than its rows, and only then all that are left
    between components. So neither near copies nor texts about one similarity apart make all their pairs, but those
    that their sketches can't tell from alike ones. Each pair is confirmed on the whole sets. Equal sets are one node.
    Null and empty texts are alike.
    """
    spark = docs.sparkSession
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def sample(it):
        hold("near_copies")
        for batch in it:
            for _, texts in batches(batch):
                h, n = np.unique(np.concatenate(shingle_sets(texts)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    seen = base.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0).mapInArrow(sample, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    common = spark.sparkContext.broadcast(np.sort(np.array([r.h for r in seen.orderBy(F.desc("n"), "h").limit(COMMON).collect()], np.int64).view(np.uint64)))

    def sets(it):
        import xxhash

        hold("near_copies")
        for batch in it:
            for k, texts in batches(batch):
                own = shingle_sets(texts)
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), seed=SEED) for x in own], np.uint64).view(np.int64)
                first = [prefix(x, common.value).view(np.int64) for x in own]
                some = [batch.column(c).slice(k, len(texts)) for c in ("doc_id", "text_hash")]
                at = np.cumsum([0, *map(len, first)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*some, pa.array(node), pa.array(majorities(own).view(np.int64)), pa.array(np.array([len(x) for x in own], np.int32)), pa.ListArray.from_arrays(at, np.concatenate(first)), pa.array([sketch(x).tobytes() for x in own], pa.binary())], ["doc_id", "text_hash", "node", "fp", "n", "prefix", "sketch"])

    prints = written(base.mapInArrow(sets, "doc_id long, text_hash long, node long, fp long, n int, prefix array<long>, sketch binary"), "prints")
    deal = lambda rows: rows.repartition(parts(spark), "h").sortWithinPartitions("h")
    # equal sets are one node; the few of them are found without their prefixes
    equal = prints.groupBy("node").agg(F.count("*").alias("k"), F.min(F.struct("text_hash", "doc_id")).alias("first")).where("k > 1")
    equal = cut(equal.select("node", F.col("first.text_hash").alias("t"), F.col("first.doc_id").alias("i")))
    spare = prints.join(equal, "node").where(~(F.col("text_hash").eqNullSafe(F.col("t")) & F.col("doc_id").eqNullSafe(F.col("i")))).select("doc_id", "text_hash").distinct()
    apart = prints.join(spare.withColumnsRenamed({"doc_id": "i", "text_hash": "t"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left_anti")
    rows = apart.select(F.posexplode("prefix").alias("pos", "h"), "node", "n").select("h", "node", "n", "pos")
    first = written(deal(rows).mapInArrow(_shared_and_stars, FIRST_PASS), "shared-shingles")
    rows = first.where("not pair").select(F.col("a").alias("h"), F.col("b").alias("node"), F.col("c").alias("n"), F.col("d").alias("pos"))
    stars = first.where("pair").select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("c").alias("shared"), F.col("d").alias("due"))

    def whole(it):
        for batch in it:
            for k, texts in batches(batch):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(k, len(texts)), pa.array([x.tobytes() for x in shingle_sets(texts)], pa.binary())], ["node", "own"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.max("due").alias("due")).where("shared >= due").select("u", "v"))
        ends = lambda pairs: pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        known = cut(prints.join(ends(pairs), "node").groupBy("node").agg(F.first("n").cast("long").alias("n"), F.first("sketch").alias("sketch")))
        of = lambda c, side: known.select(F.col("node").alias(c), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(side))
        pairs = cut(pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").mapInArrow(_near_enough, "u long, v long"))
        needed = ends(pairs)
        which = cut(prints.join(needed, "node").groupBy("node").agg(F.min("text_hash").alias("text_hash")))
        which = F.broadcast(which) if which.count() <= FEW else which
        own = written(base.join(which, "text_hash").dropDuplicates(["node"]).select("node", "text").mapInArrow(whole, "node long, own binary"), "whole-sets")
        both = pairs.join(own.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
        return cut(both.select("u", "v", "a", "b").mapInArrow(_verified, "u long, v long"))

    links = verified(stars.unionByName(close_pairs(prints).select("u", "v", F.lit(LOOK).alias("shared"), F.lit(0).cast("long").alias("due"))))
    joined = cut(connected_components(links))
    component = lambda rows: rows.join(joined.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").withColumn("comp", F.coalesce("component", "node"))
    torn = written(deal(component(rows).select("h", "node", "n", "pos", "comp")).mapInArrow(_torn, TORN), "torn-buckets")
    # who has fewer rows here than it must share with a set of the least size that it can be alike with, has no partner
    fewest = F.ceil(F.col("n") * ALIKE / OF)
    some = torn.groupBy("node", "n").agg(F.count("*").alias("k")).where(F.col("k") >= F.least(F.ceil(fewest * ALIKE / OF), 8 + F.floor(fewest / 32))).select("node", "n")
    known = prints.join(cut(some).select("node"), "node").groupBy("node").agg(F.first("n").cast("long").alias("n"), F.first("sketch").alias("sketch"))
    members = written(torn.select("key", "node").distinct().join(known, "node"), "torn-members")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    for k in range(FORESTS + 1):
        here = component(members).select("key", F.lit(True).alias("member"), zero.alias("h"), "node", "n", zero.alias("pos"), "comp", "sketch")
        crossed = here.unionByName(torn.select("key", no.alias("member"), "h", "node", "n", "pos", zero.alias("comp"), F.lit(b"").alias("sketch")))
        crossed = crossed.repartition(parts(spark), "key").sortWithinPartitions("key")
        links = links.unionByName(verified(crossed.mapInArrow(partial(_crossings, first=k < FORESTS), PAIRS)))
        joined = cut(connected_components(links))
    return prints.join(joined, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("group"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, the one with the smallest id (null ids last; of one id the smallest hash of the text); all columns stay."""
    return keep_first(docs, near_copy_groups(docs, id_col, text_col), id_col, text_col)
