"""Findings of the third review, a test each."""

import random

from pyspark.sql import functions as F

from tracewell.operators import tables as TB


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_meet_rows_without_their_grams(spark):
    """only items and rows are shuffled, not a row a gram."""
    cells = spark.createDataFrame([(1, 0, "d", "text", "part 11"), (1, 0, "q", "number", "5"), (1, 1, "d", "text", "part 22"), (1, 1, "q", "number", "5"), (1, 2, "q", "number", "7"), (1, 2, "x", "text", "ab"), (1, 3, "n", "number", "007")], "doc_id long, item int, col string, ftype string, value string")
    rows = spark.createDataFrame([(1, 0, 0, "part 11  5"), (1, 0, 1, "part 22  5"), (1, 0, 2, "7 ab"), (1, 0, 3, None)], "doc_id long, page int, row_ord int, text string")
    hits = TB.pair_hits(cells, rows)
    assert "Generate" not in plan(hits)
    # 007 reads like 7, but shares no gram with its row; the items with part share the gram of that word
    assert sorted((r.item, r.row_ord, r.n_cells) for r in hits.collect()) == [(0, 0, 2), (1, 1, 2), (2, 2, 2)]
    a = TB.assign_rows(hits)
    assert "Join" not in plan(a).split("MapInPandas")[0].split("Union")[0] and sorted((r.item, r.row_ord) for r in a.collect()) == [(0, 0), (1, 1), (2, 2)]
    # a map of territories a document, no join by item
    got = {(r.item, r.col): (r.status, r.row_ord) for r in TB.align_cells(cells, rows).collect()}
    assert got == {(0, "d"): ("verified", 0), (0, "q"): ("verified", 0), (1, "d"): ("verified", 1), (1, "q"): ("verified", 1), (2, "q"): ("verified", 2), (2, "x"): ("verified", 2), (3, "n"): ("not_found", None)}


def test_row_arithmetic_rounds_and_keeps_every_row(spark, tmp_path):
    """F8: SQL's casts round (45449.5 is 45450, and 5 in 45455 is within the tolerance); rows without a key or an amount stay."""
    from tracewell.plans.more_queries import row_arithmetic

    lines = [(1, 3, 1.0, 45449.5), (2, 3, 1.0, 45448.4), (3, 1, None, 7.0), (None, 1, 2.0, 3.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = row_arithmetic(spark, str(tmp_path))
    assert {(r.doc_id, r.k): (r.n, r.holds) for r in got.collect()} == {(1, 3): (1, True), (2, 3): (1, False), (3, 1): (1, None), (None, 1): (1, True)}


def test_characters_are_not_broadcast(spark):
    """what was exploded is larger than its estimate."""
    from tracewell.sources.files import words_with_chars
    from tracewell.sources.layout import segments_of

    p = spark.createDataFrame([(1, "ab c")], "doc_id long, text string")
    words = segments_of(p).withColumnRenamed("seg_ord", "word")
    chars = p.select("doc_id", F.lit(0).alias("page"), F.posexplode(F.split("text", "")).alias("k", "text")).where("text <> ' '")
    chars = chars.select("doc_id", "page", "text", (F.col("k") * 6.0).alias("x0"), F.lit(0.0).alias("top"), ((F.col("k") + 1) * 6.0).alias("x1"), F.lit(10.0).alias("bottom"))
    w = words_with_chars(words, chars)
    assert "BroadcastHashJoin" not in plan(w) and {r.text: len(r.char_boxes) for r in w.collect()} == {"ab": 2, "c": 1}


def test_segments_need_no_shuffle(spark):
    """F16: a word's place comes from its line alone."""
    from tracewell.sources.layout import segments_of

    s = segments_of(spark.createDataFrame([(1, " a  𝒳é b\n\nlast "), (2, ""), (3, None)], "doc_id long, text string"))
    assert "Exchange" not in plan(s) and "Sort" not in plan(s)
    assert sorted((r.doc_id, r.top, r.seg_ord % (1 << 32), r.text, r.x0, r.x1) for r in s.collect()) == [(1, 0, 1, "a", 6, 12), (1, 0, 3, "𝒳é", 24, 36), (1, 0, 4, "b", 42, 48), (1, 24, 0, "last", 0, 24)]


def test_fuzzy_spans_compare_all_that_can_be_found():
    """the spans of a search that compares every window, with few comparisons."""
    from difflib import SequenceMatcher
    from unittest import mock

    from tracewell.functions import text as T

    def every(hay, needle, least, slack):
        n, found, out = len(needle), [], []
        for width in range(max(1, n - slack), min(len(hay), n + slack) + 1):
            for at in range(len(hay) - width + 1):
                like = SequenceMatcher(None, hay[at : at + width], needle, autojunk=False).ratio()
                found += [(-like, width, at)] * (like >= least)
        for low, width, at in sorted(found):
            if not any(at < b and a < at + width for a, b, _ in out):
                out.append((at, at + width, -low))
        return out

    random.seed(3)
    for _ in range(300):
        letters = random.choice(["ab", "abc", "abcdefgh"])
        needle, hay = ("".join(random.choices(letters, k=random.randint(1, n))) for n in (14, 40))
        least, slack = random.choice([0.5, 0.7, 0.82, 0.88]), random.randint(1, 3)
        assert T.fuzzy_spans(hay, needle, least, slack) == every(hay, needle, least, slack)
    with mock.patch.object(T, "SequenceMatcher", wraps=SequenceMatcher) as made:
        asked = []
        made.side_effect = lambda **k: type("Counted", (SequenceMatcher,), {"ratio": lambda s: asked.append(1) or SequenceMatcher.ratio(s)})(**k)
        assert T.fuzzy_spans("toholdingnr000000123dear", "holdingnrq000000123", 0.82, 2)[0][:2] == (2, 20) and len(asked) <= 2


def test_searches_are_dealt(spark):
    """neither broadcast nor left to one task, and numbers meet their fields in one join (F12 to F15)."""
    from tracewell.operators import match as M

    fields = spark.createDataFrame([(1, 0, "text", "Holding Nrq 01"), (1, 1, "number", "12"), (1, 2, "number", "-1.234,50"), (1, 3, "number", "30"), (1, 4, "number", "99"), (1, 5, "percent", "21")], "doc_id long, field_ord int, ftype string, value string")
    rows = spark.createDataFrame([(1, 0, 0, "Holding Nr 01"), (1, 0, 1, "row 12000012,50 x"), (1, 0, 2, "(1 234,50) or 123450"), (1, 0, 3, "3000 of 21 %")], "doc_id long, page int, row_ord int, text string")
    words = M.match_fields(fields.where("ftype = 'text'"), rows)
    assert "BroadcastHashJoin" not in plan(words) and "REPARTITION_BY_NUM" in plan(words)
    numbers = M.match_numbers(fields.where("ftype <> 'text'"), rows.withColumn("canon", F.lit("")).hint("merge"))
    assert plan(numbers).count("SortMergeJoin") == 1
    got = sorted((r.field_ord, r.row_ord, r.start, r.end, r.score, r.exact, r.spaced) for r in numbers.collect())
    assert got == [(1, 1, 4, 6, 0.75, False, False), (1, 2, 14, 16, 0.75, False, False), (2, 2, 1, 9, 1.0, True, True), (3, 3, 0, 4, 0.85, False, False), (5, 3, 8, 10, 1.0, True, False)]


def test_pairs_by_grams_are_not_shuffled(spark):
    """a row's pairs are counted where the row is."""
    from tracewell.operators.match import gram_candidates

    random.seed(4)
    text = lambda n: "".join(random.choices("abcd ", k=n))
    items, rows = [(k, text(9)) for k in range(20)] + [(90, "ab"), (91, None)], [(k // 4, k % 4, text(15)) for k in range(40)] + [(99, 0, None)]
    got = gram_candidates(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, row_ord int, text string"))
    three = lambda t: {t.replace(" ", "")[k : k + 3] for k in range(len(t.replace(" ", "")) - 2)} if t else set()
    want = [(i, d, r, len(three(x) & three(y))) for i, x in items for d, r, y in rows if three(x) & three(y) or not three(x)]
    assert sorted((r.item_id, r.doc_id, r.row_ord, r.shared) for r in got.collect()) == sorted(want)
    counted = plan(got).split("CartesianProduct")[0].split("BroadcastNestedLoopJoin")[0]
    assert "MapInArrow" in counted and "Exchange" not in counted


def test_lines_are_built_with_one_shuffle(spark):
    """what follows the first shuffle stays within pages; heights that hang together are folded from their line's first."""
    from tracewell.operators.rows import build_rows

    seg = [(1, 0, k, f"w{k}", 10.0 * k, 3.0 * k, 10.0 * k + 8, 3.0 * k + 10) for k in range(5)]  # tolerance 5: lines begin at 0, 6 and 12
    rows = build_rows(spark.createDataFrame(seg, "doc_id long, page int, seg_ord long, text string, x0 double, top double, x1 double, bottom double"))
    assert plan(rows).count("Exchange hashpartitioning") == 1 and "Join" not in plan(rows)
    assert [r.text for r in rows.orderBy("row_ord").collect()] == ["w0 w1", "w2 w3", "w4"]


def test_shared_boxes_are_looked_for_once(spark, monkeypatch):
    """the pairs are kept, and settled fields are not joined back."""
    from tracewell.operators import resolve as RS
    from tracewell.plans import store

    kept = []
    monkeypatch.setattr(store, "kept", lambda df: kept.append(1) or df.localCheckpoint())
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    r = spark.createDataFrame([(1, k, v, "verified", 0.9, 0, (0.1, 0.1, 0.3, 0.2), None, None, [], 7) for k, v in enumerate("ab")], f"doc_id long, field_ord int, value string, status string, confidence double, page int, bbox {box}, evidence string, anchor string, notes array<string>, more int")
    c = spark.createDataFrame([(1, 0, 1, 0, (0.1, 0.1, 0.3, 0.2), None, None, 1.0, True)], f"doc_id long, field_ord int, rank int, page int, bbox {box}, evidence string, anchor string, score double, exact boolean")
    out = RS.resolve_shared(r, c)
    assert len(kept) == 1 and sorted((x.field_ord, x.status, x.confidence, x.more) for x in out.collect()) == [(0, "low_confidence", 0.6, 7), (1, "low_confidence", 0.6, 7)]
