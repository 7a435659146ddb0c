"""Token ids of whole texts by the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words kept by a worker; beyond, those met only once of late are forgotten, and encoded again when they come.
CACHE_UNITS = 1_200_000
#: Units that the library encodes as one text, a line each.
JOINED = 512
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Words of letters and a mark behind them, which is a token of its own.
_MARKED = r"^\pL*[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?|)]$"
#: Places where a byte-level BPE pre-tokenizer always parts: a letter before punctuation, before white space that begins with a line end, and around the line end that closes it.
_PARTS = re.compile(rf"(?<=[{_LETTER}])(?=[.,;:!?|)])|(?<=\S)(?=\n)|(?<=\s)(?=\n\S)|(?<=\n)(?=\S)")
#: Numbers of a unit whose text has to be encoded whole, and of one not yet met.
WHOLE, NEW = -1, -2


class Encoder:
    """The ids that the tokenizer gives for whole texts.

    The pre-tokenizer of a byte-level BPE never joins what stands before a space to what follows, unless the space has
    white space on both sides; so a text is the chain of its units, the words with the space before each, and equal
    units have equal ids. A text with such a space is encoded whole. The tests hold this against whole encoding.

    Words are told apart by Arrow; each distinct one of a batch is looked up once, by number in a pool of ids, and the
    batch's ids are gathered from there.
    """

    def __init__(self, path: str, most: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.line_end = self._whole("\n")
        assert len(self.line_end) == 1
        self.clear()

    def clear(self) -> None:
        """Units by number in a pool of ids; words: those whose unit is led by a space; bare: units without a space; pieces: what units part into."""
        self.pool, self.starts, self.sizes, self.n, self.filled = np.empty(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0
        self.met = np.zeros(1 << 14, bool)  # units that were looked up again
        self.words: dict[str, int] = {}
        self.bare: dict[str, int] = {"": int(self._take(np.empty(0, "<u4"), np.zeros(1, np.int64))[0])}
        self.pieces: dict[str, int] = {}

    def forget(self) -> None:
        """Keep only words that were met again since the last time, half of `most` at most; most words of a corpus come once."""
        again = [(w, k) for w, k in self.words.items() if k != WHOLE and self.met[k]][-(self.most // 2) :]
        ids, upto = self._gather(np.array([k for _, k in again], np.int64))
        self.clear()
        self.words = dict(zip((w for w, _ in again), self._take(ids, np.diff(upto)).tolist(), strict=True))
        del again
        give_back()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _take(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Put units, whose ids stand one behind the other, into the pool; returns their numbers."""
        at, n, end = self.n, self.n + len(sizes), self.filled + len(ids)
        while n > len(self.starts):
            self.starts, self.sizes, self.met = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes]), np.append(self.met, np.zeros(len(self.met), bool))
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.starts[at:n] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[at:n] = sizes
        self.pool[self.filled : end] = ids
        self.n, self.filled = n, end
        return np.arange(at, n)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of units one behind the other, sums of their sizes from 0); WHOLE has none."""
        sizes = np.where(numbers == WHOLE, 0, self.sizes[numbers])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.pool[np.repeat(self.starts[numbers] - upto[:-1], sizes) + np.arange(upto[-1])], upto

    def _join(self, units: list[str] | pa.Array, numbers: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Numbers of new units that are chains of others: unit k of numbers[cuts[k]:cuts[k + 1]]."""
        ids, upto = self._gather(numbers)
        out = self._take(ids, np.diff(upto[cuts]))
        for k in np.unique(np.searchsorted(cuts, np.flatnonzero(numbers == WHOLE), "right") - 1).tolist():
            out[k] = self._single(str(units[k]))
        return out

    def _single(self, unit: str) -> int:
        ids = self._whole(unit)
        return int(self._take(ids, np.array([len(ids)]))[0])

    def _lines(self, units: list[str]) -> np.ndarray:
        """Numbers of new units without a line end, many encoded as the lines of one text."""
        heaps, out = [units[k : k + JOINED] for k in range(0, len(units), JOINED)], []
        for got in self.tokenizer.encode_batch_fast(["\n".join(x) for x in heaps], add_special_tokens=False):
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(ids == self.line_end[0])
            out.append(self._take(np.delete(ids, ends), np.diff(ends, prepend=-1, append=len(ids)) - 1))
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _led(self, words: pa.Array) -> np.ndarray:
        """The numbers of the units made of a space and each word."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.words.get, distinct, repeat(NEW)), np.int64, len(distinct))
        unknown = numbers == NEW
        self.met[numbers[numbers >= 0]] = True
        if unknown.any():
            new, known = coded.dictionary.filter(pa.array(unknown)), self.words.update
            plain, marked = (m.to_numpy(zero_copy_only=False) for m in (pc.utf8_is_alpha(new), pc.match_substring_regex(new, _MARKED)))
            learned = np.empty(len(new), np.int64)
            own = new.filter(pa.array(plain)).to_pylist()
            learned[plain] = got = self._lines([" " + w for w in own])
            known(zip(own, got.tolist(), strict=True))
            if marked.any():
                some = new.filter(pa.array(marked))
                chain = np.stack([self._led(pc.utf8_slice_codeunits(some, 0, -1)), self._bare(pc.utf8_slice_codeunits(some, -1))], 1)
                learned[marked] = got = self._join([], chain.reshape(-1), np.arange(len(some) + 1) * 2)
                known(zip(some.to_pylist(), got.tolist(), strict=True))
            rest = ~(plain | marked)
            if rest.any():
                own = new.filter(pa.array(rest)).to_pylist()
                learned[rest] = got = self._odd([" " + w for w in own])
                known(zip(own, got.tolist(), strict=True))
            numbers[unknown] = learned
        return numbers[coded.indices.to_numpy()]

    def _bare(self, units: pa.Array) -> np.ndarray:
        """The numbers of units without a space."""
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = list(filterfalse(self.bare.__contains__, distinct))
        if new:
            self.bare.update(zip(new, self._odd(new).tolist(), strict=True))
        return np.fromiter(map(self.bare.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def _odd(self, units: list[str]) -> np.ndarray:
        """Numbers of new units of any look: those with a white space at an end need their text whole, others part where the pre-tokenizer parts."""
        out = np.full(len(units), WHOLE)
        lines: list[int] = []
        chains: list[tuple[int, list[str]]] = []
        for k, u in enumerate(units):
            w = u[1:] if u[0] == " " else u
            if not w or w[0].isspace() or w[-1].isspace():
                continue
            p = [u] if "<|" in u else _PARTS.split(u)
            if len(p) > 1:
                chains.append((k, p))
            elif "\n" in u or "<|" in u:
                out[k] = self._single(u)
            else:
                lines.append(k)
        out[lines] = self._lines([units[k] for k in lines])
        if chains:
            flat = [x for _, p in chains for x in p]
            cuts = np.cumsum([0, *(len(p) for _, p in chains)])
            led = np.array([x[0] == " " for x in flat])
            numbers = np.empty(len(flat), np.int64)
            numbers[led] = self._led(pa.array([x[1:] for x in flat if x[0] == " "], pa.string()))
            inner = [x for x in flat if x[0] != " "]
            new = list(filterfalse(self.pieces.__contains__, dict.fromkeys(inner)))
            plain = [x for x in new if "\n" not in x]
            self.pieces.update(zip(plain, self._lines(plain).tolist(), strict=True))
            self.pieces.update((x, self._single(x)) for x in new if "\n" in x)
            numbers[~led] = [self.pieces[x] for x in inner]
            out[[k for k, _ in chains]] = self._join([units[k] for k, _ in chains], numbers, cuts)
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one behind the other, each with the id `end` behind it, and where each text's end. Null is the empty text."""
        if len(self.words) > self.most:
            self.forget()
        texts = texts.cast(pa.string()).fill_null("")
        split = pc.split_pattern(texts, " ")
        cuts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        units = self._led(split.flatten())
        units[cuts[:-1]] = self._bare(pc.list_element(split, 0))
        ids, upto = self._gather(units)
        ends, odd = upto[cuts[1:]], np.unique(np.searchsorted(cuts, np.flatnonzero(units == WHOLE), "right") - 1)
        if len(odd):
            chains = np.split(ids, ends[:-1])
            for k in odd.tolist():
                chains[k] = self._whole(texts[k].as_py())
            ids, ends = np.concatenate(chains), np.cumsum([len(x) for x in chains])
        if end is not None:
            ids = np.insert(ids, ends, end)
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends


@lru_cache(2)
def encoder(path: str, most: int = CACHE_UNITS) -> Encoder:
    return Encoder(path, most)


def slices(batch, text_col: str = "text", n_bytes: int = 4_000_000):
    """(first row, texts) of slices of an Arrow batch with about so many bytes of text each."""
    column, k = batch.column(text_col), 0
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while k < batch.num_rows:
        before = sizes[k - 1] if k else 0
        end = max(k + 1, int(np.searchsorted(sizes, before + n_bytes, "right")))
        yield k, column.slice(k, end - k)
        k = end


def batches(batch, text_col: str = "text", n_bytes: int = 4_000_000):
    """slices() as lists of texts; null is the empty text."""
    for k, column in slices(batch, text_col, n_bytes):
        yield k, [t or "" for t in column.to_pylist()]
