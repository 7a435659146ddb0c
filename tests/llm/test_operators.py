"""The operators on small tables with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, exact_dedup, language, near_copies, packing, repair, simhash, suffix_dedup, token_counts, toxicity, url_filters
from tracewell.llm.common import connected_components, scratch

TEXTS = [(1, "same text here"), (2, "same text here"), (3, None), (4, ""), (None, "same text here"), (5, "É one"), (5, "É one"), (6, "x" * 70000), (7, "Other words entirely, and more of them.")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "h", 1, "b") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n int, block string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_exact_dedup(spark, docs, empty):
    index = exact_dedup.DigestIndex(spark, scratch(spark, "t"), 2)
    assert exact_dedup.exact_dedup(empty, index).count() == 0
    r = exact_dedup.exact_dedup(docs, index).collect()
    assert len(r) == len(TEXTS) and sum(x.kept for x in r) == 5
    same = [x for x in r if x.text_sha256 == hashlib.sha256(b"same text here").hexdigest()]
    assert {x.keep_id for x in same} == {2} and {x.group_size for x in same} == {3} and [x.doc_id for x in same if x.kept] == [2]
    again = exact_dedup.exact_dedup(docs, index).collect()
    assert not any(x.kept for x in again)
    other = exact_dedup.DigestIndex(spark, scratch(spark, "t"))
    first, second = (sorted(map(str, exact_dedup.exact_dedup(docs, other, batch="b1").collect())) for _ in range(2))
    assert first == second and other.files().count() == 5
    kept = exact_dedup.drop_copies(docs, exact_dedup.DigestIndex(spark, scratch(spark, "t"), 2))
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [2, 4, 5, 6, 7]


def test_repair_files(spark, docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    to = scratch(spark, "t")
    repair.write_shards(docs, to, path)
    r = sorted(repair.document_index(spark, to).collect(), key=lambda x: x.start)
    assert len(r) == len(TEXTS) and r[0].doc_id is None
    assert all(a.start + a.n_tokens == b.start for a, b in zip(r, r[1:])) and [x.n_tokens for x in r if x.doc_id in (3, 4)] == [1, 1]
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(path), 0
    for x, (_, text) in zip(r, sorted(TEXTS, key=lambda t: (t[0] is not None, t[0])), strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, repair.END_ID]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    repair.write_shards(empty, to + "e", path)
    assert repair.document_index(spark, to + "e").count() == 0


def test_packing(spark, docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = packing.pack(packing.token_pieces(docs, path)).collect()
    from tokenizers import Tokenizer

    whole, want = Tokenizer.from_file(path), []
    for i, text in TEXTS:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i or 0, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((x.doc_id or 0, x.piece, x.start, x.length, x.ids_crc32) for x in r) == sorted(want)
    by: dict = {}
    for x in r:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.token_pieces(empty, path)).count() == 0


def test_token_counts_and_toxicity(spark, docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    r = token_counts.token_counts(docs, path).collect()
    assert len(r) == len(TEXTS) and {x.n_tokens for x in r if x.doc_id in (3, 4)} == {0} and token_counts.token_counts(empty, path).count() == 0
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    m = toxicity.fit_toxicity(docs, labels)
    s = toxicity.score_toxicity(docs, m).collect()
    assert len(s) == len(TEXTS) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in s)
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.where("false"))).count() == len(TEXTS)


def test_simhash(spark, docs, empty):
    r = simhash.simhash_groups(docs).collect()
    assert len(r) == len(TEXTS) and {x.fingerprint for x in r if x.doc_id in (3, 4)} == {"0" * 16}
    assert {x.component_id for x in r if x.doc_id in (3, 4)} == {3} and {x.component_id for x in r if x.doc_id in (1, 2, None)} == {1}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 3, 5, 6, 7]
    assert simhash.simhash_groups(empty).count() == 0


def test_simhash_hot_blocks(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(5)} | set(base)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {x: x for x in signed}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                u, v = root(a), root(b)
                want[max(u, v)] = min(u, v)
    for limit in (200_000, 1):
        monkeypatch.setattr(simhash, "HOT_BLOCK", limit)
        got = {r.node: r.component for r in connected_components(simhash.near_links(df)).collect()}
        assert {x: got.get(x, x) for x in signed} == {x: root(x) for x in signed}


def test_near_copies_against_brute_force(spark, empty, monkeypatch):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    rows = [(None, ""), (500, None), (501, "one two"), (502, "One  two")]
    for k in range(40):
        base = [word() for _ in range(rng.randint(3, 120))]
        for j in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((10 * k + j, " ".join(w) + (" a line that very many of the texts have in common" if k % 2 else "")))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    want = {min((i is None, i or 0) for (i, _), r in zip(rows, root, strict=True) if r == g) for g in set(root)}
    assert 40 < len(want) < len(rows) - 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (8, 1):
        monkeypatch.setattr(near_copies, "LEAST", least)
        kept = near_copies.drop_near_copies(docs)
        assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(want)
    assert near_copies.drop_near_copies(empty).count() == 0


def _group_about_one_similarity(n):
    """Texts of one base in which every few words another stands: some pairs are alike, most nearly."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    return [" ".join(rng.choice("abcdefgh") * 3 if rng.random() < 0.01 * (1 + k % 3) else w for w in base) for k in range(n)]


def test_crossings_of_a_large_group_make_no_more_rows_than_it_has():
    sets = near_copies.shingle_sets(sorted(set(_group_about_one_similarity(700))))
    prefixes = [near_copies.prefix(s, np.zeros(0, np.uint64)).view(np.int64) for s in sets]
    rows = sorted((int(h), k, len(sets[k]), pos, k) for k, p in enumerate(prefixes) for pos, h in enumerate(p))
    read = lambda rows, names: [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)]
    torn = pa.Table.from_batches(near_copies._torn(iter(read(rows, ["h", "node", "n", "pos", "comp"])))).to_pylist()
    buckets = {}
    for h, k, *_ in rows:
        buckets.setdefault(h, set()).add(k)
    assert {(r["h"], r["node"]) for r in torn} == {(h, k) for h, b in buckets.items() if len(b) > 1 for k in b}

    def crossed(comp, first):
        members = {(r["key"], r["node"]) for r in torn}
        t = [(key, True, 0, k, len(sets[k]), 0, comp[k], near_copies.sketch(sets[k]).tobytes()) for key, k in members]
        t += [(r["key"], False, r["h"], r["node"], r["n"], r["pos"], 0, b"") for r in torn]
        names = ["key", "member", "h", "node", "n", "pos", "comp", "sketch"]
        return [(r["u"], r["v"], r["shared"], r["due"]) for b in near_copies._crossings(iter(read(sorted(t, key=lambda x: x[0]), names)), first) for r in b.to_pylist()]

    alike = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if near_copies.alike(sets[i], sets[j])}
    assert 10 * len(sets) < len(alike) < len(sets) ** 2 / 8
    found = {}
    for u, v, shared, due in crossed(range(len(sets)), False):
        n, _ = found.get((u, v), (0, 0))
        found[u, v] = n + shared, due
    assert alike <= {p for p, (shared, due) in found.items() if shared >= due}
    comp = np.arange(len(sets))
    for first in (True, True, False):
        links = crossed(comp, first)
        assert len(links) <= len(torn) / 4
        good = np.array([(u, v) for u, v, _, _ in links if (u, v) in alike], int).reshape(-1, 2)
        simhash.link(comp, good[:, 0], good[:, 1])
        comp = simhash.roots_of(comp, np.arange(len(sets)))
    want = np.arange(len(sets))
    simhash.link(want, *np.array(sorted(alike)).T)
    assert comp.tolist() == simhash.roots_of(want, np.arange(len(sets))).tolist()


def test_sketches_never_part_alike_sets():
    rng = np.random.default_rng(3)
    for n in (1, 9, 505, 515, 1030, 5000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 10], rng.integers(0, 2**64, len(a) // 20, np.uint64)]))
        far = near_copies.Sketches([near_copies.sketch(x) for x in (a, b)]).differ(np.array([0]), np.array([1]))[0]
        assert 0 <= far <= len(np.setxor1d(a, b)) and near_copies.near_enough(len(a), len(b), far)
        c = rng.integers(0, 2**64, n, np.uint64)
        far = near_copies.Sketches([near_copies.sketch(x) for x in (a, c)]).differ(np.array([0]), np.array([1]))[0]
        assert far and (n < 9 or not near_copies.near_enough(len(a), len(c), far))


def test_near_copies_of_a_large_group_against_brute_force(spark, monkeypatch):
    texts = _group_about_one_similarity(150)
    sets, root = near_copies.shingle_sets(texts), np.arange(150)
    pairs = [(i, j) for i in range(150) for j in range(i) if near_copies.alike(sets[i], sets[j])]
    simhash.link(root, *np.array(pairs).T)
    want = sorted(set(simhash.roots_of(root, np.arange(150)).tolist()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 1 < len(want) < 140
    for rounds in (2, 0):
        monkeypatch.setattr(near_copies, "FORESTS", rounds)
        assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == want


def test_pipeline_drops_near_copies_of_many_bits(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for k in range(20):
        w = [f"w{rng.randrange(3000)}" for _ in range(60)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_pipeline_links_near_copies_by_simhash_first(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(9)
    rows = []
    for k in range(12):
        w = [f"w{rng.randrange(3000)}" for _ in range(1500)]
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join([*w[:-1], "other"])), (3 * k + 2, " ".join([*w, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_copies.shingle_sets([t for _, t in rows])
    fp = simhash.majorities(sets).tolist()
    prints = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for (i, _), x in zip(rows, fp, strict=True)], "node long, fp long")
    root = list(range(36))
    for i in range(36):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root = [root[j] if r == root[i] else r for r in root]
    links = connected_components(near_copies.close_pairs(prints)).collect()
    got = {r.node: r.component for r in links}
    group = lambda of: sorted(sorted(i for i in range(36) if of(i) == g) for g in {of(i) for i in range(36)})
    assert links and group(lambda i: got.get(i, i)) == group(root.__getitem__)
    # with no pair of the exact join at hand, what the index links goes all the same
    monkeypatch.setattr(near_copies, "possible", lambda na, pa_, nb, pb: np.zeros(len(na), bool))
    kept = [r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted({min(i for i in range(36) if root[i] == g) for g in set(root)}) and len(kept) < 36


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 900}, {"block_bytes": 900, "hot": 2}])
def test_suffix_dedup_against_brute_force(spark, settings):
    rng = random.Random(2)
    line = "a line that many of the documents have, over and over, é. "
    texts = []
    for k in range(24):
        body = "".join(rng.choices("abcd ", k=rng.randint(0, 200)))
        texts.append((k, (body + line + body[:60] + texts[k // 2][1][:90]) if k > 2 else body))
    texts += [(3, texts[5][1]), (40, None), (None, texts[6][1]), (41, texts[6][1])]
    texts += [(42 + k, line + "".join(rng.choices("abcd ", k=30))) for k in range(9)] + [(60, "long " * 30_000), (61, "g " * 40_000)]
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in texts], "doc_id long, text string, block string, bucket int").repartition(3, "text")
    r = suffix_dedup.remove_repeats(docs, **settings).collect()
    number = lambda i: 1 << 62 if i is None else i
    want = []
    for i, t in texts:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        less = b"\0\0".join((u or "").encode() for j, u in texts if number(j) < number(i))
        for p in range(len(b) - 49):
            if b[p : p + 50] in less:
                gone[p : p + 50] = b"\1" * 50
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((-1 if i is None else i, len(b), sum(gone), bytes(gone).replace(b"\1", b"x").split(b"\0").__len__() and sum(1 for q in range(len(b)) if gone[q] and (not q or not gone[q - 1])), hashlib.sha256(rest).hexdigest(), rest))
    got = [(-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) for x in r]
    assert sorted(got) == sorted(want)


def test_suffix_dedup_of_nothing(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    short = spark.createDataFrame([(1, "a"), (2, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(short).collect()) == [(1, 1, 0, b"a"), (2, 0, 0, b""), (2, 1, 0, b"a")]


def test_suffix_dedup_blocks_are_bounded_whatever_the_splits(spark):
    docs = spark.range(400).select("id", F.repeat(F.lit("0123456789"), 100).alias("text")).withColumnRenamed("id", "doc_id")
    for splits in (1, 3, 40):
        name = f"blocks_of_{splits}"
        assert suffix_dedup._into_blocks(docs.coalesce(1) if splits == 1 else docs.repartition(splits), name, 20_000) == 20
        sizes = [r.n for r in spark.table(name).groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).collect()]
        assert sum(sizes) == 400_000 and len(sizes) >= 18 and max(sizes) <= 50_000


def test_suffix_dedup_keeps_equal_strings_of_hot_anchors_once():
    import pyarrow as pa

    text = "".join(random.Random(3).choices("abcdefgh ", k=400))
    block = suffix_dedup.Block.of(pa.table({"doc_id": pa.array([*range(30)]), "text": [text] * 30, "block": pa.array([0] * 30, pa.int32())}))
    h, _, _ = suffix_dedup.anchors(block.data, block.ends)
    marks = pa.table({"kind": pa.array([0], pa.int32()), "data": pa.array([suffix_dedup._pack(np.unique(h) << np.uint64(8) | np.uint64(1))], pa.binary())})
    c = suffix_dedup.Contexts.of(block, marks)
    own = c.texts.to_pylist()
    assert len(own) == len(set(own)) == 351 and (np.diff(c.keys.astype(np.int64)) >= 0).all() and (c.least == 0).all()
    assert len(c.at) == 30 * 351 and all(bytes(block.data[a : a + 50]) == own[k] for a, k in zip(c.at.tolist(), c.code.tolist(), strict=True))
    assert (np.bincount(c.row) == 351).all()


def test_decontaminate(spark, docs, empty):
    words = " ".join(f"w{k}" for k in range(14))
    items = spark.createDataFrame([(1, words), (10, "Short Item"), (2, None), (3, "!!")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x " + words.upper() + " y"), (2, "a short, item; and Short item"), (3, None), (2, "ÉW0 w1"), (4, " ".join(words.split()[:9]))], "doc_id long, text string")
    r = sorted(decontaminate.decontaminate(d, items).collect(), key=lambda x: (x.doc_id, -x.n_words))
    assert [(x.doc_id, x.n_words, x.n_hit, x.n_items) for x in r] == [(1, 16, 14, 1), (2, 6, 4, 1), (2, 2, 0, 0), (3, 0, 0, 0), (4, 9, 0, 0)]
    assert r[1].items_sha256 == hashlib.sha256(b"10").hexdigest() and [tuple(s) for s in r[1].spans] == [(1, 2), (4, 5)]
    assert decontaminate.decontaminate(d, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert sorted(x.doc_id for x in decontaminate.drop_contaminated(d, items).collect()) == [2, 3, 4]


def test_url_filter(spark):
    page = lambda i, u, h="": (i, u, h)
    rows = [page(1, "http://A.net/x"), page(2, "https://m.example.net/en/1?q"), page(3, "https://z.io/1", '<link href="http://a.net/x" rel="canonical">'), page(4, None), page(5, "no scheme"), page(6, "http://z.io/2", "<meta http-equiv=refresh content=\"0; url=/1\">"), page(7, "http://q.io/"), page(7, "http://q.io/")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    r = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filters.url_filter(pages, url_filters.rules_table(spark)).collect()}
    assert r[1] == ("a.net", "/x", "net/", "block") and r[2] == ("m.example.net", "/en/1", "example.net/en/", "allow")
    assert r[3] == ("z.io", "/1", None, "block") and r[6][3] == "block" and r[4] == r[5] == ("", "", None, "allow") and r[7][3] == "allow"
    assert url_filters.url_filter(pages, url_filters.rules_table(spark)).count() == len(rows)


def test_page_edges_of_any_link(spark):
    link = '<link rel=canonical href="{}">'.format
    rows = [(1, "http://a.net/p/q", link("/login?next=http://b.net/x")), (2, "http://a.net/p/q/r", link("../c") + link("./d/../e")), (3, "http://a.net", link("..")), (4, "https://a.net/z", link("//B.net/y#f")), (5, "http://a.net/k", link("?a=1")), (6, None, link("/x")), (7, "http://a.net/n", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = sorted((r.u, r.v) for r in url_filters.page_edges(pages).collect())
    assert edges == sorted([("a.net/p/q", "a.net/login?next=http://b.net/x"), ("a.net/p/q/r", "a.net/p/c"), ("a.net/p/q/r", "a.net/p/q/e"), ("a.net/", "a.net/"), ("a.net/z", "b.net/y"), ("a.net/k", "a.net/k?a=1")])


def test_url_filter_against_brute_force(spark):
    """Chains of redirects, whose closure is taken in Python."""
    rng = random.Random(8)
    hosts = ["a.net", "x.example.net", "b.io", "c.io", "d.org", "www.example.com", "e.io"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'x'])}/{k}" for k in range(80)]
    redirects = [(rng.choice(urls), rng.choice(urls)) for _ in range(45)]
    pages = spark.createDataFrame([(k, u, "junk", "h") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r.verdict for r in url_filters.url_filter(pages, url_filters.rules_table(spark), spark.createDataFrame(redirects, "src string, dst string")).collect()}

    def rule(u):
        host, path = u[7:].split("/", 1)
        fit = [(len(h + p), v == "allow", v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fit)[2] if fit else None

    group = {u: {u} for u in urls}
    for a, b in redirects:
        both = group[a] | group[b]
        for u in both:
            group[u] = both
    for k, u in enumerate(urls):
        said = {rule(x) for x in group[u]}
        assert got[k] == (rule(u) or ("allow" if "allow" in said else "block" if "block" in said else "allow"))
    assert {"allow", "block"} == set(got.values()) and url_filters.url_filter(pages.where("false"), url_filters.rules_table(spark)).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(4)
    vocabulary = {"aa": "kato mitu pola resa dunika", "bb": "xyrth qwolm vrzek grpst", "cc": "où été forêt élan çà"}
    rows = [(k, " ".join(rng.choices(vocabulary[y].split(), k=12)), y, "s") for k in range(150) for y in [["aa", "bb", "cc"][k % 3]]]
    rows += [(200, None, "aa", "s"), (201, "12 34 ..", "bb", "s"), (202, "", None, "s"), (203, "kato mitu", None, "s"), (204, "kato " * 20_000, "aa", "s"), (203, "kato mitu", None, "s"), (None, "xyrth qwolm", "bb", "s")]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = language.fit_language(texts, train_docs=60)
    assert net.langs == ["aa", "bb", "cc"]
    r = language.identify(texts, net).collect()
    assert len(r) == len(rows) and all(0 <= x.score <= 1 for x in r)
    said = {x.doc_id: x for x in r}
    assert all(said[k].lang_pred == "und" and said[k].score == 0 for k in (200, 201, 202))
    assert said[203].lang_pred == said[204].lang_pred == "aa" and said[None].lang_pred == "bb" and not said[None].held_out
    assert sum(said[k].lang_pred == y for k, _, y, _ in rows[:150]) >= 148
    assert {k for k in range(150) if said[k].held_out} == {k for k in range(150) if zlib.crc32(str(k).encode()) % 5 == 0}
    kept = language.keep_languages(texts, net)
    assert kept.columns == texts.columns and not {200, 201, 202} & {x.doc_id for x in kept.collect()}
    assert language.identify(empty, net).count() == 0
    nothing = language.fit_language(texts.where("false"))
    assert {x.lang_pred for x in language.identify(texts, nothing).collect()} == {"und"}


def test_language_keeps_every_language(spark):
    rows = [(k, f"word{k} some text", f"l{k // 8}") for k in range(8 * 230)]
    net = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=10)
    assert len(net.langs) >= 229


def test_drop_contaminated_keeps_columns(spark):
    words = " ".join(f"w{k}" for k in range(14))
    texts = spark.createDataFrame([(1, "x " * 60_000 + words, 1), (1, "clean", 2), (None, None, 3)], "doc_id long, text string, __text_hash int")
    items = spark.createDataFrame([(7, words)], "item_id long, text string")
    left = decontaminate.drop_contaminated(texts, items)
    assert left.columns == texts.columns and sorted(r["__text_hash"] for r in left.collect()) == [2, 3]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = {"aa": ["kato", "mitu", "pola", "resa", "dunika", "foru"], "bb": ["xyrth", "qwolm", "vrzek", "grpst", "thrkl"]}
    body = lambda y, n: " ".join(rng.choice(vocabulary[y]) + rng.choice("aeiou") for _ in range(n))
    item = " ".join(f"item{k}" for k in range(12))
    rows = [(k, body(y, 60), y) for k in range(40) for y in ["aa" if k % 2 else "bb"]]
    rows += [(50, rows[3][1], "aa"), (51, rows[3][1], "aa"), (52, rows[4][1] + " xyrtha", "bb"), (53, body("aa", 30) + " " + item + " pola", "aa"), (54, None, "aa"), (55, "...", None), (56, rows[5][1], None), (56, rows[5][1], None), (None, body("bb", 50), "bb")]
    texts = spark.createDataFrame([(i, t, y, "src", len(t or "")) for i, t, y in rows], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id is not None, r.doc_id) for r in df.select("doc_id").collect())
    all_but = lambda *gone: sorted((i is not None, i) for i, _, _ in rows if i not in gone)
    docs = stages["language"](spark, texts, str(tmp_path))
    assert ids(docs) == all_but(54, 55) and docs.columns == texts.columns
    docs = stages["exact_dedup"](spark, docs, str(tmp_path))
    assert ids(docs) == sorted(set(all_but(54, 55, 3, 50, 5))) and docs.columns == texts.columns
    docs = stages["near_dedup"](spark, docs, str(tmp_path))
    assert ids(docs) == sorted(set(all_but(54, 55, 3, 50, 5, 52))) and docs.columns == texts.columns
    docs = stages["decontaminate"](spark, docs, str(tmp_path))
    assert ids(docs) == sorted(set(all_but(54, 55, 3, 50, 5, 52, 53))) and docs.columns == texts.columns
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert len(pieces) == docs.count() and len({p.sequence_id for p in pieces}) == -(-sum(p.length for p in pieces) // 2048)
    nothing = texts.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name


def test_pipeline_stages_begin_with_heaps_given_back(spark):
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    texts = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    before = whole()
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, texts, "")
    assert whole() > before and sorted((p.doc_id, p.length, p.offset) for p in pieces.collect()) == [(1, 3, 0), (2, 1, 3)]


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}
    assert connected_components(e.where(F.lit(False))).count() == 0
