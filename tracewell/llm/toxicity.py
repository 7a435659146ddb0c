"""Operator 2. Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, table
from .language import held_out
from .tokens import batches

#: The machine is fitted on at most so many labelled documents of each label, those of the smallest hash, whole.
TRAIN_DOCS = 3000
BITS, FACTORS, EPOCHS, RATE, LEAST_DOCS = 20, 8, 25, 0.3, 3
#: Terms that get parameters: those whose documents are labelled toxic more or less often than all by so large a chi-square, those in so large a share of documents, and both of a pair whose documents differ by so large a chi-square from those of either alone.
CHI2, COMMON = 25.0, 0.2
#: Pairs are looked for among so many terms, the most frequent.
PAIR_TERMS = 3000
#: Soft threshold on weights at each step, and decay of factors: only terms that keep earning their weight have one.
L1, L2 = 3e-4, 1e-3
THRESHOLD = 0.3
CACHE_WORDS = 500_000
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are terms too, so that inflected and joined forms share what is learned.
BEGINNINGS = (4, 6)


def terms(word: str) -> set[int]:
    """Hashes of a word and of its beginnings."""
    mask = (1 << BITS) - 1
    return {zlib.crc32(word.encode()) & mask, *(zlib.crc32(f"{word[:n]}~{n}".encode()) & mask for n in BEGINNINGS if len(word) >= n)}


def text_terms(text: str) -> np.ndarray:
    out: set[int] = set()
    for w in set(_WORD.findall(text.lower())):
        out |= terms(w)
    return np.array(sorted(out), np.int64)


def paired_terms(docs: list[np.ndarray], y: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Terms of pairs that tell what neither term does: documents with both are labelled otherwise than those with either."""
    some = np.argsort(-n, kind="stable")[:PAIR_TERMS]
    some = some[n[some] >= LEAST_DOCS]
    at = np.full(len(n), -1)
    at[some] = np.arange(len(some))
    has = np.zeros((len(docs), len(some)), "f4")
    for k, d in enumerate(docs):
        has[k, at[d][at[d] >= 0]] = 1
    bad = has[y > 0]
    both, hit = has.T @ has, bad.T @ bad
    share = np.clip(toxic[some] / n[some], 1e-3, 1 - 1e-3)[:, None]
    off = (np.abs(hit - both * share) - 0.5).clip(0) ** 2 / np.maximum(both * share * (1 - share), 1e-9)
    off = np.minimum(off, off.T)  # against the one, and against the other
    np.fill_diagonal(off, 0)
    return some[((off >= CHI2) & (both >= LEAST_DOCS)).any(1)]


class FactorizationMachine:
    """score = sigmoid(bias + sum of w over a document's terms + sum over pairs of terms of <v_i, v_j>)."""

    def __init__(self, bias: float = -3.0):
        self.bias, self.at = bias, np.full(1 << BITS, -1, np.int64)
        self.w, self.v = np.zeros(0), np.zeros((0, FACTORS))

    def raw(self, rows: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, factor sums) of documents whose rows stand one behind the other; cuts: their starts and the end."""
        upto = lambda x: np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
        v = self.v[rows]
        each = lambda x: np.diff(upto(x)[cuts], axis=0)
        s = each(v)
        return self.bias + each(self.w[rows]) + 0.5 * ((s * s).sum(1) - each((v * v).sum(1))), s

    def fit(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 5) -> None:
        """Adagrad over batches; weight: of each document, so that a sample by label counts as the labels are shared."""
        rng = np.random.default_rng(seed)
        n = np.bincount(np.concatenate([*docs, np.zeros(0, np.int64)]), minlength=1 << BITS)
        toxic = np.bincount(np.concatenate([*[d for d, v in zip(docs, y, strict=True) if v], np.zeros(0, np.int64)]), minlength=1 << BITS)
        share = max(1, y.sum()) / len(y)
        off = (np.abs(toxic - n * share) - 0.5).clip(0) ** 2 / np.maximum(n * share * (1 - share), 1e-9)
        keep = (n >= LEAST_DOCS) & ((off >= CHI2) | (n >= COMMON * len(docs)))
        keep[paired_terms(docs, y, n, toxic)] = True
        often = np.flatnonzero(keep)
        self.at[often] = np.arange(len(often))
        docs = [(r := self.at[d])[r >= 0] for d in docs]
        self.w, self.v = np.zeros(len(often)), rng.normal(0, 0.01, (len(often), FACTORS))
        prior = float((y * weight).sum() / weight.sum())
        self.bias = float(np.log(prior / (1 - prior)))
        gw, gv, gb = np.full(len(often), 1e-2), np.full((len(often), FACTORS), 1e-2), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), 64):
                pick = order[k : k + 64]
                rows = np.concatenate([docs[i] for i in pick])
                sizes = np.array([len(docs[i]) for i in pick])
                out, s = self.raw(rows, np.concatenate([[0], np.cumsum(sizes)]))
                p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
                d = (p - y[pick]) * weight[pick]
                of = np.repeat(np.arange(len(pick)), sizes)
                own, where = np.unique(rows, return_inverse=True)
                dw = np.bincount(where, d[of], len(own))
                dv = np.stack([np.bincount(where, d[of] * (s[of, f] - self.v[rows, f]), len(own)) for f in range(FACTORS)], 1) + L2 * self.v[own]
                gb += d.sum() ** 2
                self.bias -= RATE * d.sum() / np.sqrt(gb)
                gw[own] += dw**2
                gv[own] += dv**2
                step = RATE / np.sqrt(gw[own])
                w = self.w[own] - step * dw
                self.w[own] = np.sign(w) * np.maximum(np.abs(w) - step * L1 * len(pick), 0)
                self.v[own] -= 0.3 * RATE / np.sqrt(gv[own]) * dv
        kept = np.flatnonzero((np.abs(self.w) > 1e-3) | (np.abs(self.v).max(1) > 0.03) if len(often) else [])
        self.at[:] = -1
        self.at[often[kept]] = np.arange(len(kept))
        self.w, self.v = self.w[kept], self.v[kept]


class Scorer:
    def __init__(self, machine: FactorizationMachine):
        self.machine, self.known = machine, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        m, known, cuts, rows = self.machine, self.known, [0], []
        if len(known) > CACHE_WORDS:
            known.clear()
        for text in texts:
            own = set(_WORD.findall(text.lower()))
            for w in filterfalse(known.__contains__, own):
                known[w] = tuple(r for r in (int(m.at[t]) for t in terms(w)) if r >= 0)
            mine = set().union(*map(known.__getitem__, own))
            rows.extend(sorted(mine))
            cuts.append(len(rows))
        out, _ = m.raw(np.array(rows, np.int64), np.array(cuts))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


_SCORERS: dict[int, Scorer] = {}


def _score(it: Iterator[pa.RecordBatch], machine: FactorizationMachine) -> Iterator[pa.RecordBatch]:
    hold("toxicity", _SCORERS.clear)
    key = zlib.crc32(machine.w.tobytes() + machine.v.tobytes() + machine.at.tobytes())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(machine)
    for batch in it:
        for k, texts in batches(batch):
            s = _SCORERS[key].scores(texts)
            kept = [batch.column(c).slice(k, len(texts)) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.float64()), pa.array(s >= THRESHOLD).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        found = [text_terms(t or "").astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "terms"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> FactorizationMachine:
    """Fit a machine to labelled documents that are not held out. Terms are taken on the executors; the driver gets hashes of at most 2 * train_docs texts.

    Rows with a null id or label are not learned from; of an id labelled twice the larger label holds. Without both
    labels the machine has a bias only.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id"), 4, 2))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    machine = FactorizationMachine()
    if len(total) < 2:
        return machine
    few = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs) for y in (0, 1)]
    few = F.broadcast(few[0].unionByName(few[1]))
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).join(few, "doc_id")
    y_of = own.select("doc_id", "y").distinct()
    got = own.select("doc_id", "text").mapInArrow(_extract, "doc_id long, terms binary").join(F.broadcast(y_of), "doc_id").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.terms)))
    if not got:
        return machine
    y = np.array([float(r.y) for r in got])
    taken = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.array([total[int(v)] / taken[int(v)] for v in y])
    machine.fit([np.frombuffer(r.terms, "<i4").astype(np.int64) for r in got], y, weight / weight.mean())
    return machine


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from THRESHOLD on).

    Only the text is scored, whole; null counts as empty, whose score is the bias. Repeated rows each get their row,
    an empty table gives none, other columns are not read.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col], 4, 2).alias("held_out"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(lambda it: _score(it, machine), "doc_id long, held_out boolean, score double, predicted int")


def op2_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
