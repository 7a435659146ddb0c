"""Operator 9. Repeated passages by suffix arrays built by linear grouping."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, scratch, table

LENGTH, ANCHOR = 50, 20
#: Bytes of text that a step of numpy works on, and of a block of documents, about.
STEP, BLOCK_BYTES = 1_000_000, 16_000_000
#: An anchor in more documents than this is hot: its strings are dealt each by its own hash.
HOT = 2000
#: Symbols that are sorted together; strings of which fewer than ALONGSIDE are alike long, or of more than LONG symbols, are sorted one by one.
SORTED, ALONGSIDE, LONG = 300_000, 64, 20_000
#: Contexts of a block are told apart in 2 ** PARTS ranges of their keys.
PARTS = 4
LAST = np.iinfo(np.int64).max


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array by grouping (Baier 2016). s ends with its one smallest symbol.

    First suffixes are grouped by their first symbol. Groups are taken from the highest down; when a group is taken,
    its suffixes' Lyndon prefixes are known in full. Each of its suffixes points to the last suffix before it in a
    lower group; those that are pointed at, by as many, leave their group for a new one just above it, for their
    prefixes go on with as many copies of the taken group's. Then the order within groups is emitted from the lowest
    suffix up along the same pointers; no suffix is renamed or compared.
    """
    n = len(s)
    symbols = sorted(set(s))
    rank = {c: g for g, c in enumerate(symbols)}
    group = [rank[c] for c in s]
    lists: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        lists[g].append(i)
    size = [len(m) for m in lists]
    up, down = [*range(1, len(lists)), -1], [*range(-1, len(lists) - 1)]
    prev, done = [-1] * n, bytearray(n)
    g = len(lists) - 1
    while g >= 0:
        if size[g] == 1:  # most groups; the steps below for one suffix
            for i in lists[g]:
                if group[i] == g:
                    break
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0 and size[h := group[j]] > 1:
                group[j] = new = len(lists)
                lists.append([j])
                size.append(1)
                size[h] -= 1
                up.append(up[h])
                down.append(h)
                down[up[h]] = new
                up[h] = new
            g = down[g]
            continue
        own = [i for i in lists[g] if group[i] == g]
        own.sort()
        for i in own:
            done[i] = 1
        count: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in count.items():
            moved.setdefault((k, group[j]), []).append(j)
        for k, h in sorted(moved, reverse=True):  # more copies lie higher
            js = moved[k, h]
            if len(js) == size[h]:
                continue  # all of it goes on alike
            new = len(lists)
            lists.append(js)
            size.append(len(js))
            size[h] -= len(js)
            up.append(up[h])
            down.append(h)
            down[up[h]] = new
            up[h] = new
            for j in js:
                group[j] = new
        g = down[g]
    start, at, g = [0] * len(lists), 0, 0
    while g >= 0:
        start[g] = at
        at += size[g]
        g = up[g]
    out = [-1] * n
    out[0], placed = n - 1, bytearray(n)
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[start[g]] = i
            start[g] += 1
            placed[i] = 1
            i = prev[i]
    return out


def suffix_arrays(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """suffix_array() of many strings that stand one behind the other, step by step alongside each other; places count in s.

    The groups of a string lie in `perm` from the lowest up, so that the next to be taken ends where the last began,
    and suffixes that leave a group go to its end. group holds where a suffix's group begins, end where a group that
    begins there ends. The place after the last, `none`, stands for no suffix.
    """
    n, none = len(s), len(s)
    own = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
    key = own * (int(s.max(initial=0)) + 1) + s
    perm = np.argsort(key, kind="stable")
    key = key[perm]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.zeros(n + 1, np.int64)
    end[begins] = np.append(begins[1:], n)
    group, place = np.empty(n + 1, np.int64), np.empty(n, np.int64)
    group[perm] = np.repeat(begins, np.diff(begins, append=n))
    place[perm] = np.arange(n)
    before = np.arange(-1, n)
    before[starts] = none
    prev, done, moving = before.copy(), np.zeros(n + 1, bool), np.zeros(n, bool)
    at, first = np.append(starts[1:], n), starts
    while len(at):
        low = group[perm[at - 1]]
        size = at - low
        upto = np.cumsum(size)
        i = perm[np.repeat(at - upto, size) + np.arange(upto[-1])]
        done[i] = True
        j = before[i]
        while (on := np.flatnonzero(done[j])).size:
            j[on] = prev[j[on]]
            prev[i] = j
        prev[i] = j
        j = np.sort(j[j != none])
        if len(j):
            new = np.concatenate([[True], j[1:] != j[:-1]])
            copies = np.diff(np.flatnonzero(new), append=len(j))
            j = j[new]
            h = group[j]
            order = np.lexsort((copies, h))
            j, copies, h = j[order], copies[order], h[order]
            lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            m = np.diff(lead, append=len(h))
            base = end[h[lead]] - m
            slot = np.repeat(base - lead, m) + np.arange(len(j))
            moving[j] = True
            there = perm[slot]
            there = there[~moving[there]]
            left = place[j]
            left = left[left < np.repeat(base, m)]
            perm[left], place[there] = there, left
            perm[slot], place[j] = j, slot
            moving[j] = False
            rest = base > h[lead]
            end[h[lead][rest]] = base[rest]
            lead = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (copies[1:] != copies[:-1])]))
            size = np.diff(lead, append=len(j))
            group[j] = np.repeat(slot[lead], size)
            end[slot[lead]] = slot[lead] + size
        more = low > first
        at, first = low[more], first[more]
    out, placed, to = np.empty(n, np.int64), np.zeros(n + 1, bool), np.arange(n + 1)
    placed[none] = True
    out[starts] = np.append(starts[1:], n) - 1
    k, stop = starts, np.append(starts[1:], n)
    while len(k):
        i = before[out[k]]
        while (i := i[~placed[i]]).size:
            g = group[i]
            out[to[g]] = i
            to[g] += 1
            placed[i] = True
            i = prev[i]
        k = k + 1
        more = k < stop
        if not more.all():
            k, stop = k[more], stop[more]
    return out


def _sorted_suffixes(s: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Suffix arrays, as places in s, of the strings that begin at starts; in any order of the strings."""
    sizes = np.diff(starts, append=len(s))
    order = np.argsort(sizes, kind="stable")
    k = 0
    while k < len(order):
        first = int(sizes[order[k]])
        some = order[k : k + max(1, SORTED // first)]
        some = some[sizes[some] <= 1.5 * first]
        total = np.cumsum(sizes[some])
        some = some[: max(1, int(np.searchsorted(total, SORTED, "right")))]
        k += len(some)
        if len(some) < ALONGSIDE or first > LONG:
            for x in some.tolist():
                a, b = int(starts[x]), int(starts[x] + sizes[x])
                yield np.array(suffix_array(s[a:b].tolist()), np.int64) + a
        else:
            own = sizes[some]
            to = np.cumsum(own) - own
            at = np.repeat(starts[some] - to, own) + np.arange(int(own.sum()))
            yield at[suffix_arrays(s[at], to)]


def window_minima(data: np.ndarray, ends: np.ndarray, numbers: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of each string where a string of `length` bytes starts: the least number of the strings of its group that hold the same.

    The strings stand one behind the other in data, those of a group together. A group's strings are joined, each
    closed by a mark, and sorted; equal strings lie side by side in the suffix array.
    """
    sizes = np.diff(ends, prepend=0)
    n_windows = sizes - length + 1
    out = np.repeat(numbers, n_windows)
    lead = np.concatenate([[True], groups[1:] != groups[:-1]])
    several = ~(lead & np.append(lead[1:], True))  # a string alone in its group meets no other
    if not several.any():
        return out
    own = np.flatnonzero(several)
    closes = np.append(lead[1:], True)[own]  # a group's last string is closed by the least symbol too
    took = sizes[own] + 1 + closes
    to = np.cumsum(took) - took
    s = np.zeros(int(took.sum()), np.int64)
    s[to + sizes[own]] = 1
    within = np.arange(int(sizes[own].sum())) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
    s[np.repeat(to, sizes[own]) + within] = data[np.repeat(ends[own] - sizes[own], sizes[own]) + within].astype(np.int64) + 2
    # the window that starts at a symbol, and the string's number there
    window = np.full(len(s), -1, np.int64)
    n = n_windows[own]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(to, n) + within
    window[at] = np.repeat((np.cumsum(n_windows) - n_windows)[own], n) + within
    words = [s[k : len(s) - length + 1 + k] for k in range(length)] if len(s) >= length else []
    for suffixes in _sorted_suffixes(s, to[lead[own]]):
        here = suffixes[window[suffixes] >= 0]
        new = np.ones(len(here), bool)
        same = np.arange(1, len(here))
        for w in words:  # few neighbours stay equal for long
            same = same[w[here[same]] == w[here[same - 1]]]
            if not len(same):
                break
        new[same] = False
        runs = np.flatnonzero(new)
        w = window[here]
        out[w] = np.repeat(np.minimum.reduceat(out[w], runs), np.diff(runs, append=len(w)))
    return out


def _gram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of bytes: hashes of widths 1, 2, 4, ... are joined to that of k."""
    n, base, h = len(buf), np.uint64(0x9E3779B97F4A7C15), None
    x = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    power, width, at, rest = base, 1, 0, k
    while rest:
        if rest & 1:
            h = x[: n - k + 1] if h is None else h * power + x[at : at + n - k + 1]
            at += width
        rest >>= 1
        if rest:
            x = x[: len(x) - width] * power + x[width:]
            power, width = np.multiply([power], [power])[0], 2 * width
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): runs of string starts that have their anchor in common, in documents that stand one behind the other.

    The anchor of a string of `length` bytes is its k-gram of least hash, the leftmost of equals; equal strings have
    equal anchors at one place in them. hash has 40 bits, and collisions only add candidates.
    """
    n, none = len(buf), np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none
    h = _gram_hash(buf, k)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least, width, span = key, 1, length - k + 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: n - length + 1], least[span - width : span - width + n - length + 1])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(n - length + 1, bool)
    starts = np.concatenate([[0], ends[:-1]])
    for a, b in zip(np.maximum(ends - length + 1, starts).tolist(), ends.tolist(), strict=True):
        inside[a:b] = False
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    close = np.ones(len(inside), bool)
    close[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(close & inside)
    return (h[anchor[first]] * np.uint64(0x94D049BB133111EB)) >> np.uint64(24), first, last  # mixed anew, since the least are small


class Block(NamedTuple):
    """A block's documents, ordered by id and text, so that each pass sees the same."""

    ids: np.ndarray  # LAST for null
    data: np.ndarray  # all texts' bytes
    ends: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Block:
        t = t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")]))
        texts = t.column("text").cast(pa.large_string()).combine_chunks().cast(pa.large_binary())
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
        ids = t.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)
        return cls(ids, *_bytes_of(texts))

    def steps(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, first byte, bytes, ends) of some documents at a time, about STEP bytes."""
        k = 0
        while k < len(self.ends):
            start = int(self.ends[k - 1]) if k else 0
            last = max(k + 1, int(np.searchsorted(self.ends, start + STEP, "right")))
            yield k, start, self.data[start : self.ends[last - 1]], self.ends[k:last] - start
            k = last


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(b, "u1").reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _number(t: pa.Table) -> int:
    return t.column("block")[0].as_py()


def _dealt(number: int, keys: np.ndarray, n_buckets: int, columns: dict[str, tuple]) -> pa.Table:
    """A row for each bucket of the ascending 40-bit keys; columns: the bytes of each bucket's keys, by name (all bytes, where each key's begin and the last's end)."""
    cuts = np.searchsorted((keys * np.uint64(n_buckets)) >> np.uint64(40), np.arange(n_buckets + 1))
    used = np.flatnonzero(cuts[1:] > cuts[:-1])
    out = {"bucket": pa.array(used, pa.int32()), "block": pa.array([number] * len(used), pa.int32())}
    for c, (data, starts) in columns.items():
        at = starts[np.append(cuts[used], cuts[-1])]
        if at[-1] < 1 << 31:
            out[c] = pa.BinaryArray.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        else:
            out[c] = pa.chunked_array([pa.array([memoryview(data)[a:b]], pa.binary()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    return pa.table(out)


def _block_anchors(t: pa.Table, n_buckets: int) -> pa.Table:
    """Per bucket the anchors of a block of documents, and about how many of its documents have each (16 times its binary logarithm)."""
    found = []
    for k, _, data, ends in Block.of(t).steps():
        h, first, _ = anchors(data, ends)
        found.append(_distinct(h, k + np.searchsorted(ends, first, "right")))
    h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
    packed = h << np.uint64(8) | np.minimum(255, 16 * np.log2(n)).astype(np.uint64)
    give_back()
    return _dealt(_number(t), h, n_buckets, {"data": (_pack(packed), 6 * np.arange(len(h) + 1))})


def _distinct(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The hashes, once for each document that has them."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    return h[np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])] if len(h) else h


def _repeated(t: pa.Table, many: int) -> pa.Table:
    """Per block its anchors that more than one document has; the last bit tells whether an anchor is hot, in about more than `many`."""
    each = [_unpack(d.as_py()) for d in t.column("data")]
    packed = np.concatenate(each)
    _, which = np.unique(packed >> np.uint64(8), return_inverse=True)
    about = np.exp2((packed & np.uint64(255)).astype(np.float64) / 16)
    docs, blocks = np.bincount(which, about), np.bincount(which)
    again, hot = ((blocks > 1) | (docs > 1))[which], (docs > many)[which]
    marks = packed >> np.uint64(8) << np.uint64(8) | hot.astype(np.uint64)
    cuts = np.cumsum([len(x) for x in each])[:-1]
    out = [_pack(m[a]) for m, a in zip(np.split(marks, cuts), np.split(again, cuts), strict=True)]
    return pa.table({"block": t.column("block"), "kind": pa.array([0] * len(out), pa.int32()), "data": pa.array(out, pa.binary())})


class Contexts(NamedTuple):
    """The runs of strings of a block whose anchors are repeated, with all their bytes; equal ones have one number."""

    row: np.ndarray  # of each run
    at: np.ndarray  # its place in the block's bytes
    code: np.ndarray  # its context's number
    texts: pa.Array  # the distinct contexts, ascending by their keys
    keys: np.ndarray  # where each is dealt: its anchor, or its own hash if the anchor is hot
    least: np.ndarray  # the smallest doc_id of the block that has it

    @classmethod
    def of(cls, block: Block, marks: pa.Table) -> Contexts:
        packed = [_unpack(d.as_py()) for d, kind in zip(marks.column("data"), marks.column("kind").to_pylist(), strict=True) if kind == 0]
        packed = np.sort(np.concatenate([np.zeros(0, np.uint64), *packed]))
        repeated, hot = packed >> np.uint64(8), (packed & np.uint64(1)) > 0
        rows, places, codes, keys, found = [], [], [], [], []
        for k, start, data, ends in block.steps():
            h, first, last = anchors(data, ends)
            nth = np.searchsorted(repeated, h)
            hit = np.flatnonzero(np.append(repeated, np.uint64(1 << 63))[nth] == h)
            first, last, h, nth = first[hit], last[hit], h[hit], nth[hit]
            each = hot[nth]
            if each.any():  # every string by itself
                n = last[each] - first[each] + 1
                own = np.repeat(first[each], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                h = np.concatenate([h[~each], _gram_hash(data, LENGTH)[own] >> np.uint64(24)])
                first, last = np.concatenate([first[~each], own]), np.concatenate([last[~each], own])
            # a step's distinct ones only are kept: strings of hot anchors are many, and mostly equal
            coded = _slices(data, first, last + LENGTH).dictionary_encode()
            code = coded.indices.to_numpy()
            key = np.zeros(len(coded.dictionary), np.uint64)
            key[code] = h
            found.append(coded.dictionary)
            keys.append(key)
            codes.append(code)
            rows.append((k + np.searchsorted(ends, first, "right")).astype(np.int32))
            places.append(start + first)
        # equal contexts have equal keys, so a range of keys at a time tells them apart
        texts, of_key, n = [pa.array([], pa.large_binary())], [np.zeros(0, np.uint64)], 0
        numbers = [np.empty(len(x), np.int32) for x in keys]
        for part in range(1 << PARTS):
            some = [np.flatnonzero(x >> np.uint64(40 - PARTS) == np.uint64(part)) for x in keys]
            coded = pa.concat_arrays([texts[0], *(d.take(pa.array(x)) for d, x in zip(found, some, strict=True))]).dictionary_encode()
            own, which = np.zeros(len(coded.dictionary), np.uint64), coded.indices.to_numpy()
            own[which] = np.concatenate([of_key[0], *(x[y] for x, y in zip(keys, some, strict=True))])
            order = np.argsort(own, kind="stable")
            rank = np.empty(len(own), np.int32)
            rank[order] = np.arange(n, n + len(own), dtype=np.int32)
            for x, y, to in zip(numbers, some, np.split(rank[which], np.cumsum([len(y) for y in some])[:-1]), strict=True):
                x[y] = to
            texts.append(coded.dictionary.take(pa.array(order)))
            of_key.append(own[order])
            n += len(own)
        del found, coded
        row, code = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (rows, (x[y] for x, y in zip(numbers, codes, strict=True))))
        least = np.full(n, LAST)
        np.minimum.at(least, code, block.ids[row])
        return cls(row, np.concatenate([np.zeros(0, np.int64), *places]), code, pa.concat_arrays(texts), np.concatenate(of_key), least)


def _slices(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each first to its end, as a binary array."""
    size = end - first
    upto = np.concatenate([[0], np.cumsum(size)])
    own = np.empty(int(upto[-1]), "u1")
    for k in range(0, len(first), 20_000):
        n = size[k : k + 20_000]
        at = upto[k : k + len(n) + 1]
        own[at[0] : at[-1]] = data[np.repeat(first[k : k + len(n)] - at[:-1], n) + np.arange(at[0], at[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(own)])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a large binary array without nulls; the bytes are not copied."""
    if not len(texts):
        return np.zeros(0, "u1"), np.zeros(0, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", "u1")[at[0] : at[-1]], at[1:] - at[0]


def _block_contexts(t: pa.Table, marks: pa.Table, n_buckets: int) -> pa.Table:
    """Per bucket the distinct contexts of a block's repeated anchors, each with its number and the least doc_id."""
    *_, texts, keys, least = Contexts.of(Block.of(t), marks)
    data, ends = _bytes_of(texts)
    starts = np.concatenate([[0], ends])
    give_back()
    raw = lambda a, kind: (a.astype(kind).view("u1"), np.arange(len(a) + 1) * np.dtype(kind).itemsize)
    columns = {"keys": raw(keys, "<u8"), "texts": (data, starts), "sizes": raw(np.diff(starts), "<u4"), "codes": raw(np.arange(len(keys)), "<u4"), "least": raw(least, "<i8")}
    return _dealt(_number(t), keys, n_buckets, columns)


CONTEXTS = "bucket int, block int, keys binary, texts binary, sizes binary, codes binary, least binary"
_SPAN = np.dtype([("code", "<u4"), ("at", "<u4"), ("n", "<u4")])


def _solve(t: pa.Table) -> pa.Table:
    """For each block the places in its contexts where a string also is in a document of smaller doc_id than the block has for that context."""
    column = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(c)])
    keys, sizes, codes, least = column("keys", "<u8"), column("sizes", "<u4").astype(np.int64), column("codes", "<u4"), column("least", "<i8")
    of_row = np.repeat(np.arange(t.num_rows), [len(x.as_py()) // 4 for x in t.column("sizes")])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(t.column("texts").to_pylist()))])
    coded = texts.dictionary_encode()
    which, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    of_key, lowest = np.zeros(n, np.uint64), np.full(n, LAST)
    of_key[which] = keys
    np.minimum.at(lowest, which, least)
    order = np.argsort(of_key, kind="stable")
    data, ends = _bytes_of(coded.dictionary.take(pa.array(order)))
    minima = window_minima(data, ends, lowest[order], of_key[order])
    windows = np.diff(ends, prepend=0) - LENGTH + 1
    upto = np.cumsum(windows)
    # runs of equal minima in a context
    new = np.ones(len(minima), bool)
    new[1:] = minima[1:] != minima[:-1]
    new[upto[:-1]] = True
    runs = np.flatnonzero(new)
    size, value = np.diff(runs, append=len(minima)), minima[runs]
    lead = np.searchsorted(runs, upto - windows)
    n_runs = np.diff(lead, append=len(runs))
    # each entry of a block with each run of its context
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    best = np.minimum.reduceat(value, lead) if n else value
    entry = np.flatnonzero(best[rank[which]] < least)
    ctx = rank[which[entry]]
    m = n_runs[ctx]
    run = np.repeat(lead[ctx] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
    entry, ctx = np.repeat(entry, m), np.repeat(ctx, m)
    less = value[run] < least[entry]
    run, entry, ctx = run[less], entry[less], ctx[less]
    spans = np.empty(len(run), _SPAN)
    spans["code"], spans["at"], spans["n"] = codes[entry], runs[run] - (upto - windows)[ctx], size[run]
    cuts = np.searchsorted(of_row[entry], np.arange(t.num_rows + 1))
    used = [k for k in range(t.num_rows) if cuts[k] < cuts[k + 1]]
    blocks = t.column("block").to_pylist()
    return pa.table({"block": pa.array([blocks[k] for k in used], pa.int32()), "kind": pa.array([1] * len(used), pa.int32()), "data": pa.array([spans[cuts[k] : cuts[k + 1]].tobytes() for k in used], pa.binary())})


def _cut_out(t: pa.Table, marks: pa.Table, texts: bool) -> pa.Table:
    """The documents of a block without their repeated strings."""
    block = Block.of(t)
    c = Contexts.of(block, marks)
    spans = np.frombuffer(b"".join(d.as_py() for d, kind in zip(marks.column("data"), marks.column("kind").to_pylist(), strict=True) if kind == 1), _SPAN)
    spans = spans[np.argsort(spans["code"], kind="stable")]
    c, size = c._replace(texts=None), pc.binary_length(c.texts).to_numpy().astype(np.int32)
    own = block.ids[c.row]
    whole = np.flatnonzero(c.least[c.code] < own)  # the block itself has a smaller one
    part = np.flatnonzero(c.least[c.code] == own)
    del own
    first, last = [c.at[whole]], [c.at[whole] + size[c.code[whole]]]
    lead, end = (np.searchsorted(spans["code"], c.code[part], side) for side in ("left", "right"))
    n = end - lead
    which = np.repeat(lead - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    first.append(np.repeat(c.at[part], n) + spans["at"][which])
    last.append(first[1] + spans["n"][which] + (LENGTH - 1))
    del c, spans, whole, part, lead, end, n, which
    a, b = np.concatenate(first), np.concatenate(last)
    del first, last
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    del order
    row = np.searchsorted(block.ends, a, "right").astype(np.int32)  # documents stand one behind the other
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] > b[:-1])
    lead = np.flatnonzero(new)
    row, a, b = row[lead], a[lead], b[np.append(lead[1:], len(b))[: len(lead)] - 1]
    cuts = np.searchsorted(row, np.arange(len(block.ids) + 1)).tolist()
    data, starts = memoryview(block.data), np.concatenate([[0], block.ends])
    size, left, digests, out = np.diff(block.ends, prepend=0), [], [], []
    for k, (x, y) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        kept, upto = [], x
        for p, q in zip(a[cuts[k] : cuts[k + 1]].tolist(), b[cuts[k] : cuts[k + 1]].tolist(), strict=True):
            kept.append(data[upto:p])
            upto = q
        rest = b"".join([*kept, data[upto:y]])
        left.append(len(rest))
        digests.append(hashlib.sha256(rest).hexdigest())
        out.append(rest if texts else None)
    give_back()
    return pa.table({
        "doc_id": pa.array(block.ids, mask=block.ids == LAST), "n_bytes": size, "n_removed": size - np.array(left, np.int64), "n_spans": np.diff(cuts),
        "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(out, pa.binary()),
    })


def _into_blocks(base: DataFrame, name: str, block_bytes: int) -> int:
    """Write (doc_id, text) as a table bucketed by block and return how many blocks there are.

    A block holds about block_bytes, however many the input splits are: the bytes of all splits in a row are cut into
    blocks, and the documents of a split are dealt by chance over the blocks that its bytes fall into. A block's number
    is one that Spark's hash puts into the bucket meant, so no text is shuffled, now or when the table is read.
    """
    spark = base.sparkSession
    sizes = {r.split: r.size for r in base.select(F.spark_partition_id().alias("split"), F.octet_length("text").alias("size")).groupBy("split").agg(F.sum("size").alias("size")).collect()}
    n = max(1, -(-sum(sizes.values()) // block_bytes))
    ids = F.col("id").cast("int")
    found = spark.range(64 * n).groupBy(F.pmod(F.hash(ids), F.lit(n)).alias("bucket")).agg(F.min(ids).alias("block")).orderBy("bucket")
    numbers = F.array(*[F.lit(r.block) for r in found.collect()])  # one for each block
    own = np.array([sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)], np.float64) / block_bytes
    of_split = lambda x, other: F.coalesce(F.get(F.array(*map(F.lit, x.tolist())), F.spark_partition_id()), F.lit(other))
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(1 << 30)
    place = F.floor(of_split(np.cumsum(own) - own, 0.0) + of_split(own, float(n)) * chance).cast("int")
    dealt = base.withColumn("block", F.get(numbers, F.least(place, F.lit(n - 1))))
    dealt.write.bucketBy(n, "block").option("compression", "zstd").format("parquet").saveAsTable(name, path=scratch(spark, name))
    return n


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Remove each byte that lies in a string of LENGTH bytes which also starts in a document of smaller doc_id.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left; null unless
    texts). Null is the empty text. A null doc_id is greater than all others; equal ids, in several rows, remove
    nothing of each other. An empty table gives no rows; other columns are not read. A text of any length is read
    whole; it is a block of its own if it is longer than one.

    Documents lie in blocks of about block_bytes, written once as a table bucketed by block, so that no pass moves the
    texts. A string's anchor tells where equal strings can meet: anchors that one document alone has are left out; for
    the others each block sends its distinct contexts, once however many of its documents hold them. Where contexts of
    an anchor meet, equal strings in them are found by suffix arrays. Strings around an anchor of more than `hot`
    documents are dealt by their own hash, so no anchor's contexts must be in one task. A passage in a third of all
    documents costs an entry for each block, not for each document.
    """
    spark = docs.sparkSession
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    buckets = 4 * _into_blocks(base, name, block_bytes)  # of anchors
    blocks = spark.table(name).select("block", "doc_id", "text")
    found = blocks.groupBy("block").applyInArrow(lambda t: _block_anchors(t, buckets), "bucket int, block int, data binary")
    marks = cut(found.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _repeated(t, hot), "block int, kind int, data binary"))
    contexts = blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda t, m: _block_contexts(t, m, buckets) if t.num_rows else _none(CONTEXTS), CONTEXTS)
    replies = cut(contexts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_solve, "block int, kind int, data binary"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return blocks.groupBy("block").cogroup(marks.unionByName(replies).groupBy("block")).applyInArrow(lambda t, m: _cut_out(t, m, texts) if t.num_rows else _none(out), out)


def _none(shape: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.table({c: pa.array([], kinds[k]) for c, k in (x.split() for x in shape.split(", "))})


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")
