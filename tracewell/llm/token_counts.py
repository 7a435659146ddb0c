"""Operator 3. Token counts under a unigram vocabulary, by dynamic programming shared over a trie of pre-tokens."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, table
from .tokens import batches

#: Nodes of a worker's trie; beyond, it is begun anew.
TRIE_NODES = 900_000
#: Added to the lowest score of the vocabulary for each UTF-8 byte of a character that no piece holds.
BYTE_PENALTY = 10.0
WORD_START = "▁"


class UnigramTrie:
    """Pre-tokens in a trie. A node holds the forward score of its prefix: the best sum of piece scores that spells it, and how many pieces that is.

    A node is made once for all pre-tokens that share the prefix, and its score then looks at the nodes above only.
    Of equal scores the one with fewer pieces, then the one with the longer last piece, is taken.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - BYTE_PENALTY
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node * 2**21 + code point
        self.score, self.count = array("d", [0.0]), array("l", [0])
        self.terminal: dict[str, tuple[int, float]] = {}

    def insert(self, word: str) -> None:
        """Add a pre-token; terminal[word] is then (pieces, score)."""
        node, path, child = 0, [0], self.child
        for d, ch in enumerate(word):
            key = node << 21 | ord(ch)
            below = child.get(key)
            if below is None:
                below = child[key] = self._grow(word, d + 1, path)
            node = below
            path.append(node)
        self.terminal[word] = self.count[node], self.score[node]

    def _grow(self, word: str, end: int, path: list[int]) -> int:
        pieces, score, count = self.pieces, self.score, self.count
        best, fewest = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            s = pieces.get(word[start:end])
            if s is not None:
                up = path[start]
                now = score[up] + s
                if now > best or now == best and count[up] + 1 < fewest:
                    best, fewest = now, count[up] + 1
        if word[end - 1] not in pieces:
            n, up = len(word[end - 1].encode()), path[end - 1]
            if (now := score[up] + n * self.byte) > best:
                best, fewest = now, count[up] + n
        score.append(best)
        count.append(fewest)
        return len(score) - 1

    def total(self, text: str) -> tuple[int, int, float]:
        """(pre-tokens, tokens, score) of a text: white-space words, each with a word start before it."""
        words = text.split()
        for w in set(filterfalse(self.terminal.__contains__, words)):
            self.insert(w)
        found = list(map(self.terminal.__getitem__, words))
        if len(self.score) > TRIE_NODES:
            self.clear()
        return len(words), sum(n for n, _ in found), math.fsum(s for _, s in found)


class _Started(UnigramTrie):
    """The trie below the word start, which every pre-token shares."""

    def insert(self, word: str) -> None:
        super().insert(WORD_START + word)
        self.terminal[word] = self.terminal.pop(WORD_START + word)


def vocabulary(model_path: str) -> dict[str, float]:
    """Pieces of a SentencePiece model and their log-probabilities by rank (Zipf: -ln(rank + 2)); control, unknown and byte pieces are left out.

    The public model is of the BPE kind, whose own scores are ranks and not probabilities.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    real = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(k + 2) for k, i in enumerate(real)}


@lru_cache(2)
def _trie(model_path: str) -> UnigramTrie:
    return _Started(vocabulary(model_path))


def _count(it: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    hold("trie", _trie.cache_clear)
    trie = _trie(model_path)
    for batch in it:
        ids = batch.column("doc_id")
        for k, texts in batches(batch):
            a, b, c = zip(*map(trie.total, texts), strict=True)
            yield pa.RecordBatch.from_arrays([ids.slice(k, len(texts)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_pretokens (white-space words), n_tokens and score of the best unigram segmentation of each word.

    Null and empty texts count zero. Repeated rows each get their row; an empty table gives none; other columns are
    not read. Each worker keeps its trie from batch to batch, up to TRIE_NODES; nothing is shuffled.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(lambda it: _count(it, model_path), "doc_id long, n_pretokens long, n_tokens long, score double")


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
