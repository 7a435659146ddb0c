"""Operator 4. Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hold, table
from .tokens import batches

#: Documents that the network is fitted on, at most, or one a language if there are more languages: those of the smallest hash; and distinct words of each. All else covers every document.
TRAIN_DOCS, TRAIN_WORDS = 1500, 200
HIDDEN, EMBED, STEPS, BATCH, RATE = 16, 12, 700, 384, 0.01
#: Bytes of a reading window. The state is begun anew at white space, and inside longer words after so many bytes.
WINDOW = 32
#: Distinct words whose labels a worker keeps.
CACHE_WORDS = 600_000
UNKNOWN = "und"
#: What keep_languages() asks for; with four languages a toss-up has 0.25.
LEAST_SCORE = 0.4


class BiGRU:
    """Two gated recurrent layers read a word's bytes from both ends; each position gets a probability for each language.

    Parameters are float32 arrays by name; f and b at the end of a name tell the direction.
    """

    def __init__(self, langs: list[str], seed: int = 7, hidden: int = HIDDEN, embed: int = EMBED):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        u = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype("f4")
        self.p = {"e": u(257, embed) * 4, "o": u(2 * hidden, len(langs)), "c": np.zeros(len(langs), "f4")}
        for d in "fb":
            self.p |= {f"w{d}": u(embed, 3 * hidden), f"u{d}": u(hidden, 3 * hidden), f"v{d}": np.zeros(3 * hidden, "f4")}

    def _read(self, x: np.ndarray, live: np.ndarray | None, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, N, H) of one direction. x: (T, N) bytes, 256 where a word is over; live: x < 256, None if everywhere. A state waits where the word is over."""
        p, h = self.p, self.h
        rows = p["e"] @ p[f"w{d}"] + p[f"v{d}"]
        state, out = np.zeros((x.shape[1], h), "f4"), np.empty((*x.shape, h), "f4")
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = state @ p[f"u{d}"]
            given = np.take(rows, x[t], axis=0)
            zr = 1 / (1 + np.exp(-(given[:, : 2 * h] + g[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(given[:, 2 * h :] + r * g[:, 2 * h :])
            new = n + z * (state - n)
            if live is not None:
                new = np.where(live[t][:, None], new, state)
            if keep is not None:
                keep.append((t, state, z, r, n, g[:, 2 * h :]))
            out[t] = state = new
        return out

    def label(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(labels, n): the sum over a word's positions of the log-probabilities of the languages, and its positions. words: 1 to WINDOW bytes each."""
        n = np.array([len(w) for w in words])
        out = np.empty((len(words), len(self.langs)), "f4")
        for size in np.unique(n):  # words of one length have no padding
            same = np.flatnonzero(n == size)
            for at in np.split(same, range(2048, len(same), 2048)):
                x = np.frombuffer(b"".join([words[i] for i in at]), "u1").reshape(len(at), size).T
                s = np.concatenate([self._read(x, None, "f"), self._read(x, None, "b")], 2) @ self.p["o"] + self.p["c"]
                s -= s.max(2, keepdims=True)
                out[at] = (s - np.log(np.exp(s).sum(2, keepdims=True))).sum(0)
        return out, n

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time, for words x (T, N) of languages y; every position has its word's language."""
        p, h, live = self.p, self.h, x < 256
        kept: dict[str, list] = {"f": [], "b": []}
        s = np.concatenate([self._read(x, live, d, kept[d]) for d in "fb"], 2)
        q = s @ p["o"] + p["c"]
        q = np.exp(q - q.max(2, keepdims=True))
        q /= q.sum(2, keepdims=True)
        t, k = np.nonzero(live)
        loss = float(-np.log(q[t, k, y[k]] + 1e-9).mean())
        dq = q * live[:, :, None]
        dq[t, k, y[k]] -= 1
        dq /= len(t)
        grad = {"o": np.einsum("tnh,tnk->hk", s, dq), "c": dq.sum((0, 1))}
        ds, de = dq @ p["o"].T, np.zeros_like(p["e"])
        for i, d in enumerate("fb"):
            du, da = np.zeros_like(p[f"u{d}"]), np.zeros((*x.shape, 3 * h), "f4")
            back = np.zeros((x.shape[1], h), "f4")
            for t, state, z, r, n, g in reversed(kept[d]):
                on = live[t][:, None]
                up = back + ds[t, :, i * h : (i + 1) * h]
                here = np.where(on, up, 0)
                dn = here * (1 - z) * (1 - n * n)
                dz = here * (state - n) * z * (1 - z)
                dr = dn * g * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                da[t] = np.concatenate([dz, dr, dn], 1)
                du += state.T @ dg
                back = np.where(on, here * z + dg @ p[f"u{d}"].T, up)
            flat = da.reshape(-1, 3 * h)
            table_ = np.zeros((257, 3 * h), "f4")
            np.add.at(table_, x.reshape(-1), flat)
            grad |= {f"u{d}": du, f"v{d}": flat.sum(0), f"w{d}": p["e"].T @ table_}
            de += table_ @ p[f"w{d}"].T
        return loss, grad | {"e": de}

    def fit(self, words: list[bytes], langs: list[int], steps: int = STEPS, seed: int = 7) -> float:
        """Adam over random batches of words; languages are drawn alike often. Returns the mean loss of the last 50 steps."""
        rng, y = np.random.default_rng(seed), np.array(langs)
        of = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        of = [x for x in of if len(x)]
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        losses = []
        for i in range(1, steps + 1):
            pick = np.concatenate([x[rng.integers(0, len(x), BATCH // len(of) + 1)] for x in of])
            x = np.full((WINDOW, len(pick)), 256)
            for c, w in enumerate(pick):
                x[: len(words[w]), c] = np.frombuffer(words[w], "u1")
            loss, grad = self.step(x[: max(len(words[w]) for w in pick)], y[pick])
            losses.append(loss)
            rate = RATE * min(1, 2 * (1 - (i - 1) / steps))
            for k, g in grad.items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                self.p[k] -= (rate * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)).astype("f4")
        return float(np.mean(losses[-50:]))


def reading_words(text: str) -> list[bytes]:
    """What the network reads of a text: its words, each led by a space, long ones in windows."""
    out = []
    for w in text.encode().split():
        w = b" " + w
        out += [w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w), WINDOW)]
    return out


class Reader:
    """Labels of distinct words, kept from batch to batch: a word's labels depend on nothing but the word."""

    def __init__(self, net: BiGRU):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.labels = np.empty((0, len(self.net.langs)), "f4")
        self.sizes = np.empty(0, np.int64)

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Per text the mean over all its positions of the languages' log-probabilities."""
        if not self.net.langs:
            return np.zeros((len(texts), 0))
        if len(self.number) > CACHE_WORDS:
            self.clear()
        chains = [reading_words(t) for t in texts]
        new: set[bytes] = set()
        for c in chains:
            new.update(filterfalse(self.number.__contains__, c))
        if new:
            some = list(new)
            labels, sizes = self.net.label(some)
            self.number.update(zip(some, range(len(self.sizes), len(self.sizes) + len(some)), strict=True))
            self.labels, self.sizes = np.concatenate([self.labels, labels]), np.concatenate([self.sizes, sizes])
        out = np.zeros((len(texts), len(self.net.langs)))
        for i, c in enumerate(chains):
            if c:
                at = np.fromiter(map(self.number.__getitem__, c), np.int64, len(c))
                out[i] = self.labels[at].sum(0, dtype="f8") / self.sizes[at].sum()
        return out


_READERS: dict[int, Reader] = {}


def _reader(net: BiGRU) -> Reader:
    key = zlib.crc32(b"".join(v.tobytes() for v in net.p.values()))
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(net)
    return _READERS[key]


def _predict(it: Iterator[pa.RecordBatch], net: BiGRU, sharp: float) -> Iterator[pa.RecordBatch]:
    hold("language", _READERS.clear)
    reader = _reader(net)
    for batch in it:
        for k, texts in batches(batch):
            s = reader.pooled(texts) * sharp
            q = np.exp(s - s.max(1, keepdims=True)) if s.shape[1] else np.zeros((len(texts), 1))
            q /= q.sum(1, keepdims=True) if s.shape[1] else 1
            letters = [any(map(str.isalpha, t)) for t in texts]
            best = q.argmax(1)
            names = [net.langs[j] if ok and net.langs else UNKNOWN for j, ok in zip(best, letters, strict=True)]
            scores = [float(q[i, j]) if names[i] != UNKNOWN else 0.0 for i, j in enumerate(best)]
            kept = [batch.column(c).slice(k, len(texts)) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> BiGRU:
    """Fit the network to text and language of at most train_docs labelled documents that are not held out, alike many of each language.

    Takes the documents with the smallest hashes of id and text, so the choice doesn't depend on order or partitions,
    and of each the TRAIN_WORDS distinct words of least hash, from the whole text. Every language that a document
    outside the held-out ones has is learned. Rows with a null are not learned from; without any the network knows no
    language, and repeated rows count once.
    """
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("y"))
    rows = rows.where("t is not null and y is not null and i is not null").where(~held_out(F.col("i"), 5, 0))
    hashed = rows.withColumn("k", F.xxhash64("i", "t"))
    counts = cut(hashed.groupBy("y").agg(F.count("*").alias("n")))
    langs = sorted(r.y for r in counts.select("y").collect())
    each = max(1, train_docs // max(1, len(langs)))
    # hashes are even, so the smallest `each` of a language are among a few times as many; the rest is not sorted
    share = F.pmod("k", F.lit(1 << 32)) / F.lit(float(1 << 32))
    few = hashed.select("k", "y").join(F.broadcast(counts), "y").where(share * F.col("n") < 4 * each + 40).distinct()
    nth = F.row_number().over(Window.partitionBy("y").orderBy(F.pmod("k", F.lit(1 << 32)), "k"))
    few = few.withColumn("nth", nth).where(F.col("nth") <= each).select("k", "y")
    own = hashed.join(F.broadcast(few), ["k", "y"]).dropDuplicates(["k", "y"])
    read = F.array_distinct(F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    least = F.slice(F.array_sort(F.transform(read, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), 1, TRAIN_WORDS)
    words: list[bytes] = []
    ys: list[int] = []
    at = {y: k for k, y in enumerate(langs)}
    for r in own.select("k", "y", F.transform(least, lambda x: x["w"]).alias("w")).orderBy("k", "y").collect():
        for w in r.w:
            for piece in reading_words(w):
                words.append(piece)
                ys.append(at[r.y])
    net = BiGRU(langs)
    if words and len(langs) > 1:
        net.fit(words, ys)
    return net


def identify(docs: DataFrame, net: BiGRU, id_col: str = "doc_id", text_col: str = "text", sharp: float = 8.0) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (probability of lang_pred).

    Every byte of every word is labelled; a document's probabilities are the softmax of the positions' mean
    log-probabilities, times `sharp`. lang_pred is `und`, score 0, where the text is null, has no letter, or nothing was
    learned. Repeated rows each get their row; an empty table gives none; other columns are not read.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col], 5, 0).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return base.mapInArrow(lambda it: _predict(it, net, sharp), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, net: BiGRU, least: float = LEAST_SCORE, text_col: str = "text", sharp: float = 8.0) -> DataFrame:
    """docs whose language is recognised with a score of at least `least`; all columns stay. Nothing is shuffled."""

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            ids = pa.nulls(len(column), pa.int64())
            said = _predict(iter([pa.RecordBatch.from_arrays([ids, ids, column], ["doc_id", "held_out", "text"])]), net, sharp)
            yield pa.array([p != UNKNOWN and s >= least for b in said for p, s in zip(b.column("lang_pred").to_pylist(), b.column("score").to_pylist(), strict=True)], pa.bool_())

    return docs.where(known(docs[text_col].cast("string")))


def op4_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_language(docs))
