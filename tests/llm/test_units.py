"""The methods by themselves, against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tracewell.llm import language, packing, repair, simhash, suffix_dedup, token_counts, toxicity
from tracewell.llm.tokens import Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_cached_encoding_is_whole_encoding(encoder):
    random.seed(3)
    texts = ["", " ", "a  b", "x\n \ny", "a\n\nb c", "it's <|endoftext|> x.", "don't.\n\nYou", "é.É|x)|y", "a\0b \0"]
    texts += ["".join(random.choices("ab \n\t.,'|é1", k=random.randint(0, 14))) for _ in range(1500)]
    texts += ["".join(random.choices(["foo", "Bar", "é", " ", " ", "\n", "\n\n", "\t", ".", "12", "'s", "<|endoftext|>", ")", "中", "\x1c", "\u2003"], k=random.randint(0, 12))) for _ in range(1500)]
    for some in (texts, texts[::-1], texts[7:9], []):
        ids, ends = encoder.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])][: len(some)] == [encoder._whole(t).tolist() for t in some]
    ids, ends = encoder.encode(pa.array([None, "a", ""]), 7)
    assert ids.tolist() == [7, *encoder._whole("a").tolist(), 7, 7] and ends.tolist() == [1, 3, 4]


def test_words_met_again_outlast_a_full_cache():
    small = Encoder(public_tokenizers.path("byte_bpe_50k.json"), 100)
    texts = [" ".join(["common words, and more", *(f"once{k}x{j} é{j}." for j in range(40))]) for k in range(12)]
    for k, text in enumerate(texts):
        ids, ends = small.encode(pa.array([text, None]), 0)
        whole = small.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == [*whole, 0, 0] and ends.tolist() == [len(whole) + 1, len(whole) + 2]
        assert len(small.words) <= 100 + 90 and (k < 2 or {"words,", "and", "more"} <= set(small.words))
    small.forget()
    assert {"words,", "and", "more"} <= set(small.words) and not any(w.startswith("once") for w in small.words)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        sizes = np.array([n, 1, 3])
        ids = np.concatenate([rng.integers(0, 6, n), [2], [1, 1, 1]]).astype("<u4")
        symbols, rules, own = repair.compress(ids, sizes, 10)
        assert (repair.expand(symbols, rules, 10) == ids).all() and own.sum() == len(symbols)
        lengths = repair.rule_lengths(rules, 10)
        assert all(len(repair.expand(np.array([10 + k]), rules, 10)) == x for k, x in enumerate(lengths.tolist()))
        row = {"doc_symbols": own.tobytes(), "symbols": symbols.tobytes(), "rules": rules.tobytes(), "first_rule": 10}
        assert (repair.read_document(row, 0) == ids[:n]).all() and (repair.read_document(row, 2) == [1, 1, 1]).all()
    assert len(symbols) < len(ids)


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 50_000, 1000)
    many = np.concatenate([np.tile(rng.integers(0, 50_000, 2 * 40_000), 8), np.full(100, 7)])
    docs = [np.append(x, 2) for x in [passage] * 16 + [many]]
    ids, sizes = np.concatenate(docs).astype("<u4"), np.array(list(map(len, docs)))
    symbols, rules, own = repair.compress(ids, sizes, 50_000)
    assert (repair.expand(symbols, rules, 50_000) == ids).all() and len(np.unique(rules, axis=0)) == len(rules)
    assert own[:16].max() <= 2
    pairs = np.delete(np.stack([symbols[:-1], symbols[1:]], 1), np.cumsum(own)[:-1] - 1, axis=0)
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < repair.LEAST_COUNT


def fewest(sizes, capacity):
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    random.seed(5)
    for _ in range(120):
        sizes = [random.randint(1, 20) for _ in range(random.randint(1, 8))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduce_by_dominance(counts, 20)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (fewest(left, 20) if left else 0) == fewest(sizes, 20)
        plan = packing.plan(counts, 20)
        used: dict[int, int] = {}
        for look, n in plan:
            assert sum(s * m for s, m in look.items()) <= 20
            for s, m in look.items():
                used[s] = used.get(s, 0) + m * n
        assert used == counts


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]]))
    index = simhash.GrayIndex(np.zeros(len(x), np.int64), x)
    found = {tuple(sorted((int(index.x[i]), int(index.x[j])))) for a, b in index.pairs(3) for i, j in zip(a, b, strict=True)}
    assert found == {(int(a), int(b)) for a, b in combinations(sorted(x), 2) if bin(int(a) ^ int(b)).count("1") <= 3}


def test_gray_rank():
    assert simhash.gray_rank(np.array([k ^ k >> 1 for k in range(64)], np.uint64)).tolist() == list(range(64))


def test_suffix_array_is_sorted_suffixes():
    random.seed(4)
    for _ in range(600):
        s = [random.randint(1, random.choice([1, 2, 3, 9])) for _ in range(random.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_alongside_and_least_numbers(monkeypatch):
    rng = np.random.default_rng(6)
    strings = [np.append(rng.integers(1, rng.choice([2, 3, 9]), rng.integers(0, 60)), 0) for _ in range(500)]
    starts = np.cumsum([0, *map(len, strings)])[:-1]
    got = suffix_dedup.suffix_arrays(np.concatenate(strings), starts)
    for s, a in zip(strings, starts.tolist(), strict=True):
        assert (got[a : a + len(s)] - a).tolist() == suffix_dedup.suffix_array(s.tolist())
    for alongside in (1, 10_000):
        monkeypatch.setattr(suffix_dedup, "ALONGSIDE", alongside)
        groups = [[bytes(rng.integers(97, 100, rng.integers(4, 30)).tolist()) for _ in range(rng.integers(1, 6))] for _ in range(200)]
        flat = [x for g in groups for x in g]
        numbers = rng.permutation(len(flat))
        of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        least = suffix_dedup.window_minima(np.frombuffer(b"".join(flat), "u1"), np.cumsum([len(x) for x in flat]), numbers, of, 4).tolist()
        want = [min(n for y, n, h in zip(flat, numbers.tolist(), of.tolist(), strict=True) if h == g and x[i : i + 4] in y) for x, g in zip(flat, of.tolist(), strict=True) for i in range(len(x) - 3)]
        assert least == want


def test_trie_counts_are_the_best_segmentation():
    pieces = {"a": -2.0, "b": -2.5, "ab": -3.0, "abb": -3.2, "▁": -1.0, "▁a": -2.1, "ba": -3.9}
    trie = token_counts._Started(pieces)

    def best(w):
        d = [(0.0, 0)] + [None] * len(w)
        for e in range(1, len(w) + 1):
            options = [(d[k][0] + pieces[w[k:e]], -(-d[k][1] + 1)) for k in range(e) if w[k:e] in pieces]
            if w[e - 1] not in pieces:
                n = len(w[e - 1].encode())
                options.append((d[e - 1][0] + n * trie.byte, d[e - 1][1] + n))
            d[e] = max(options, key=lambda o: o[0])
        return d[-1][0]

    random.seed(6)
    for _ in range(300):
        w = "".join(random.choices("abé", k=random.randint(1, 9)))
        n, tokens, score = trie.total(f" {w}\n{w} ")
        assert n == 2 and score == pytest.approx(2 * best("▁" + w)) and tokens >= 2
    assert trie.total("") == (0, 0, 0.0)


def test_backpropagation_through_time():
    net = language.BiGRU(["x", "y", "z"], hidden=3, embed=3)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x = np.full((5, 3), 256)
    x[:5, 0], x[:2, 1], x[:3, 2] = [1, 2, 3, 4, 5], [7, 9], [5, 5, 6]
    _, grad = net.step(x, np.array([0, 1, 2]))
    for k in grad:
        i = (2, 1) if k == "e" else (0,) * net.p[k].ndim
        old, e = net.p[k][i], 1e-3
        net.p[k][i] = old + e
        up = net.step(x, np.array([0, 1, 2]))[0]
        net.p[k][i] = old - e
        down = net.step(x, np.array([0, 1, 2]))[0]
        net.p[k][i] = old
        assert (up - down) / (2 * e) == pytest.approx(float(grad[k][i]), abs=2e-4)


def test_machine_learns_a_pair_that_no_term_shows():
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        docs.append(np.array([1] * bool(a) + [2] * bool(b) + [3], np.int64))
        y.append(float(a != b))
    m = toxicity.FactorizationMachine()
    m.fit(docs, np.array(y), np.ones(len(y)))
    score = lambda d: m.raw(np.array([r for r in m.at[d] if r >= 0]), np.array([0, sum(m.at[d] >= 0)]))[0][0]
    assert min(score([1, 3]), score([2, 3])) > max(score([1, 2, 3]), score([3]))


def test_machine_learns_a_pair_of_rare_terms():
    rng = np.random.default_rng(2)
    docs, y = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.1
        docs.append(np.array([1] * bool(a) + [2] * bool(b) + [3, *(10 + np.flatnonzero(rng.random(200) < 0.05))], np.int64))
        y.append(float(a and b) if rng.random() < 0.98 else 1.0)
    # each term alone is made as toxic as the rest: documents with one of the two are never labelled by chance
    y = np.array([0.0 if (1 in d) != (2 in d) else v for d, v in zip(docs, y, strict=True)])
    n = np.bincount(np.concatenate(docs), minlength=1 << toxicity.BITS)
    toxic = np.bincount(np.concatenate([d for d, v in zip(docs, y, strict=True) if v]), minlength=1 << toxicity.BITS)
    found = toxicity.paired_terms(docs, y, n, toxic)
    assert {1, 2} <= set(found.tolist()) and len(found) < 12
