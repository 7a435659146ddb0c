import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import rows as R
from tracewell.operators import tables as TB
from tracewell.operators import verify as C
from tracewell.operators.match import find_value, gram_candidates, match_fields
from tracewell.operators.resolve import resolve_shared, shared_boxes
from tracewell.plans import catalogue
from tracewell.plans import specs as S
from tracewell.plans.ground import ground
from tracewell.sources import layout as L


def segs(spark, items):
    return spark.createDataFrame([(1, 0, k, t, float(x), float(y), float(x + w), float(y + 10), 1.0) for k, (t, x, y, w) in enumerate(items)], "doc_id long, page int, seg_ord long, text string, x0 double, top double, x1 double, bottom double, conf double")


def test_lines_and_cells(spark):
    near = lambda y: [("Name", 0, y, 30), ("of", 36, y + 1, 12), ("Ann", 54, y, 20), ("9,50", 400, y, 30)]
    rows = R.build_rows(segs(spark, near(0) + near(20))).collect()
    assert [r.text for r in rows if not r.is_cell] == ["Name of Ann 9,50"] * 2 and {r.text for r in rows if r.is_cell} == {"Name of Ann", "9,50"}


def test_merged_rows(spark):
    rows = spark.createDataFrame([(1, 0, k, t, 0.0, 12.0 * k, 60.0, 12.0 * k + 10) for k, t in enumerate("abcd")] + [(1, 0, 9, "far", 0.0, 300.0, 60.0, 310.0)], "doc_id long, page int, row_ord int, text string, x0 double, top double, x1 double, bottom double")
    assert {r.text for r in R.merged_rows(rows).collect()} == {"a b", "a b c", "b c", "b c d", "c d"}


@pytest.mark.parametrize(
    ("kind", "value", "text", "n"),
    [("id", "FV2025001", "no FV2025001234", 0), ("id", "FV2025001", "no FV 2025 001.", 1), ("id", "2024", "20241231-77", 0), ("text", "CZK", "CZ, K", 0), ("text", "kc", "Rekchek", 0), ("text", "€", "sum € 5", 1)],
)
def test_find_value(kind, value, text, n):
    assert len(find_value(kind, value, text, False)) == n


def test_doubtful_id():
    assert find_value("id", "20260315", "2026-03-15", False)[0][3] is False


def test_ground_every_status(spark):
    docs = spark.createDataFrame([(1, "Invoice INV-77001\nTotal 1 234,50\nDate 03.05.2024\nqty 2\nAnna Long\nStreet Name")], "doc_id long, text string")
    asserted = [(1, 0, "invoice_number", "INV-77001"), (1, 1, "invoice_date", "2024-05-03"), (1, 2, "iban", None), (1, 3, "supplier_name", "Nobody Here At All"), (1, 4, "qty", "2"), (1, 5, "customer_name", "Long Street"), (1, 6, "pieces", "2")]
    specs = S.preset(spark, "invoice").unionByName(spark.sql("SELECT * FROM VALUES ('qty', 'number'), ('pieces', 'number') AS t(name, ftype)"))
    r = {x.name: x for x in ground(spark.createDataFrame(asserted, "doc_id long, field_ord int, name string, value string"), L.segments_of(docs), specs, year=F.lit(2024)).collect()}
    assert {k: v.status for k, v in r.items()} == {"invoice_number": "verified", "invoice_date": "verified", "iban": "not_present", "supplier_name": "not_found", "qty": "verified", "customer_name": "verified", "pieces": "low_confidence"}
    assert r["invoice_number"].evidence == "INV-77001" and r["pieces"].confidence == 0.6 and r["invoice_date"].evidence == "03.05.2024"


def test_table_assignment_keeps_order(spark):
    hits = spark.createDataFrame([(1, 0, 3, 2), (1, 0, 5, 1), (1, 1, 3, 3), (1, 1, 6, 1), (2, 0, 0, 2), (2, 1, 1, 2)], "doc_id long, item int, row_ord int, n_cells long")
    got = {(r.doc_id, r.item): r.row_ord for r in TB.assign_rows(hits).collect()}
    assert got[2, 0] == 0 and got[2, 1] == 1 and got[1, 1] == 3 and got[1, 0] == 5


def test_shared_boxes_are_parted(spark):
    """Documents: 1 the second field can move, 2 only the first can, 3 none can, 4 both say the same, 5 nothing is shared."""
    box = lambda y: {"x0": 0.1, "y0": y, "x1": 0.3, "y1": y + 0.1}
    shape = "struct<x0:double,y0:double,x1:double,y1:double>"
    values = {1: ("a", "b"), 2: ("a", "b"), 3: ("a", "b"), 4: ("90.00", "90,00"), 5: ("a", "b")}
    results = spark.createDataFrame([(d, k, f"f{k}", v, "verified", 0.9, 0, box(0.1 if d < 5 else 0.1 + 0.4 * k), v, None, []) for d, vs in values.items() for k, v in enumerate(vs)], f"doc_id long, field_ord int, name string, value string, status string, confidence double, page int, bbox {shape}, evidence string, anchor string, notes array<string>")
    cands = [(d, k, 1, 0, box(0.1), "e", None, 1.0, True) for d in values for k in (0, 1)] + [(1, 1, 2, 0, box(0.5), "there", "by", 1.0, False), (2, 0, 2, 0, box(0.5), "x", None, 0.8, True), (2, 1, 2, 0, box(0.1), "y", None, 0.8, True), (2, 1, 3, 0, box(0.11), "z", None, 0.8, True), (4, 1, 2, 0, box(0.5), "x", None, 0.8, True)]
    cands = spark.createDataFrame(cands, f"doc_id long, field_ord int, rank int, page int, bbox {shape}, evidence string, anchor string, score double, exact boolean")
    r = {(x.doc_id, x.field_ord): x for x in resolve_shared(results, cands).collect()}
    assert len(r) == 10
    assert (r[1, 1].bbox.y0, r[1, 1].status, r[1, 1].confidence, r[1, 1].evidence, r[1, 1].anchor) == (0.5, "low_confidence", 0.9, "there", "by") and r[1, 0].status == "verified"
    assert r[2, 0].bbox.y0 == 0.5 and r[2, 0].confidence == 0.8 and r[2, 0].status == "verified" and r[2, 1].bbox.y0 == 0.1
    assert all(r[3, k].status == "low_confidence" and r[3, k].confidence == 0.6 for k in (0, 1))
    assert all(r[4, k].status == "verified" and r[4, k].confidence == 0.9 and r[4, k].notes and r[4, k].bbox.y0 == 0.1 for k in (0, 1))
    assert not r[5, 0].notes and not r[5, 1].notes


def test_shared_boxes_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    boxes = [(0.10, 0.1, 0.90, 0.12), (0.18, 0.1, 0.90, 0.12), (0.2, 0.05, 0.22, 0.95), (0.2, 0.12, 0.22, 0.95), (0.3, 0.3, 0.3, 0.4)]
    for _ in range(25):
        x, y, w, h = rng.random(), rng.random(), rng.choice([0.01, 0.3, 0.9]) * rng.random(), rng.choice([0.01, 0.3, 0.9]) * rng.random()
        boxes += [(x + rng.uniform(-0.1, 0.1) * w, y + rng.uniform(-0.1, 0.1) * h, x + w * rng.uniform(0.92, 1), y + h * rng.uniform(0.92, 1)) for _ in range(3)]

    def over(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return 0 if w <= 0 or h <= 0 else w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    want = [(i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes)) if over(boxes[i], boxes[j]) >= 0.85]
    assert {(0, 1), (2, 3)} < set(want)
    f = spark.createDataFrame([(1, k, "v", 0, *b) for k, b in enumerate(boxes)], "doc_id long, field_ord int, value string, page int, x0 double, y0 double, x1 double, y1 double")
    got = shared_boxes(f.withColumn("bbox", F.struct("x0", "y0", "x1", "y1")))
    assert sorted((r.a, r.b) for r in got.collect()) == want


def test_gram_candidates_against_brute_force(spark):
    items, rows = [(1, "Anna Long"), (2, "ab"), (3, None), (4, "Summe 12,50"), (5, "!!")], [(1, 0, "ANNA"), (1, 1, "x"), (2, 0, "sum 1250"), (2, 3, "")]
    canonical = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    own = lambda t: {canonical(t)[k : k + 3] for k in range(len(canonical(t)) - 2)}
    want = [(i, d, r, len(own(a) & own(b))) for i, a in items for d, r, b in rows if not own(a) or own(a) & own(b)]
    got = gram_candidates(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, row_ord int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 12


def test_gram_prefilter_reads_every_item(spark, tmp_path):
    spark.createDataFrame([(1, "Anna Long"), (20, "zzz"), (3, "?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, "for Anna\nnone")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in catalogue.gram_prefilter(spark, str(tmp_path)).collect()) == [(1, 7, 0, 2), (3, 7, 0, 0), (3, 7, 1, 0)]


def test_header_bands_read_all_labels(spark):
    rows = spark.createDataFrame([(1, 0, 0, "part part", 0.0), (1, 0, 1, "qty  amount", 12.0)], "doc_id long, page int, row_ord int, text string, top double")
    labels = spark.createDataFrame([(t,) for t in ["part"] * 1500 + [f"none{k}" for k in range(1500)] + ["Qty", "Amount"]], "label string").coalesce(1)
    assert [(r.row_ord, r.n_labels) for r in TB.header_bands(rows, labels).collect()] == [(1, 2)]


def test_many_items_are_searched_in_blocks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"item number {k % 8} x") for k in range(9)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(d, f"an item\nnumber {d} x") for d in range(8)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalogue, "ITEMS_AT_ONCE", 2)
    assert sorted(tuple(r) for r in catalogue.found_passages(spark, str(tmp_path)).collect()) == sorted((k, k % 8, 0, 2) for k in range(9))


def test_relations_and_checks(spark):
    r = spark.createDataFrame([(1, "subtotal", "100", "100"), (1, "vat_amount", "21", "21"), (1, "total", "121", "121")], "doc_id long, name string, value string, evidence string")
    rel = spark.createDataFrame([("total", "sum", ["subtotal", "vat_amount"]), ("vat_amount", "percent_of", ["subtotal", "vat_rate"])], "target string, kind string, operands array<string>")
    assert {x.target: x.holds for x in C.relation_notes(r, rel).collect()} == {"total": True, "vat_amount": None}
    r = spark.createDataFrame([(1, "subtotal", "1,000", "1,000"), (1, "vat_amount", "234", "234"), (1, "total", "1,234", "1,234"), (2, "subtotal", "5", "5"), (2, "vat_amount", "2", "2"), (2, "total", "8", "8")], "doc_id long, name string, value string, evidence string")
    r = r.selectExpr("*", "'verified' status", "1.0D confidence", "cast(null as string) proof", "cast(array() as array<string>) notes")
    assert {x.doc_id: x.holds for x in C.relation_notes(r, rel).where("target = 'total'").collect()} == {1: True, 2: False}
    told = {(x.doc_id, x.name): x for x in C.with_relations(r, rel).collect()}
    assert {k: v.proof for k, v in told.items() if k[0] == 1} == {(1, n): "arithmetic" for n in ("subtotal", "vat_amount", "total")}
    assert all(v.proof is None and v.status == "verified" and v.notes == ["relation for total does not hold"] for k, v in told.items() if k[0] == 2)


def test_null_keys_are_groups(spark):
    rows = spark.createDataFrame([(d, 0, k, t, 0.0, 12.0 * k, 60.0, 12.0 * k + 10) for d in (1, None) for k, t in enumerate("abc")], "doc_id long, page int, row_ord int, text string, x0 double, top double, x1 double, bottom double")
    got = R.merged_rows(rows).collect()
    assert sorted(r.text for r in got if r.doc_id is None) == sorted(r.text for r in got if r.doc_id == 1) == ["a b", "a b c", "b c"]
    hits = spark.createDataFrame([(d, i, r, n) for d in (1, None) for i, r, n in ((0, 3, 2), (0, 5, 1), (1, 3, 3), (1, 6, 1))], "doc_id long, item int, row_ord int, n_cells long")
    assert TB.by_group(hits, ["doc_id"], ["item"], lambda t: [(t[0].item, len(t))], "item long, n long").collect() == [(0, 4), (0, 4)]


def test_prints_of_numbers_dates_and_ids(spark):
    text = "Sum 12 345,60 EUR\nlost 2733\nqty 7112,22\ncost f952\nvat 6356477S\non 3 May 2024 and 04.05.2024\nbad 1 234 5678"
    asked = [("number", "12345.60", None), ("number", "27.33", None), ("number", "7", None), ("text", "£", None), ("id", "IE6356477S", S.VAT_PATTERN), ("date", "2024-05-04", None), ("number", "1234", None), ("number", "2345.60", None)]
    fields = spark.createDataFrame([(1, k, *a) for k, a in enumerate(asked)], "doc_id long, field_ord int, ftype string, value string, pattern string")
    rows = L.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("doc_id", F.lit(0).alias("page"), F.col("line_no").alias("row_ord"), "text")
    lines = text.split("\n")
    got = {(m.field_ord, lines[m.row_ord][m.start : m.end], m.score, m.exact, m.spaced) for m in match_fields(fields, rows).collect()}
    assert got == {(0, "12 345,60", 1.0, True, True), (1, "2733", 0.85, False, False), (2, "7", 0.75, False, False), (3, "f", 0.8, False, False), (4, "6356477S", 1.0, True, False), (5, "04.05.2024", 1.0, True, False), (6, "1 234", 1.0, True, True)}


def test_declared_specs(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"total": {"type": "number", "proof": {"sum": ["a", "b"]}}, "items": {"type": "table", "columns": {"qty": "number"}}}')
    specs, rel = S.resolve_specs(spark, str(tmp_path / "s.json"))
    assert {r.name: r.ftype for r in specs.collect()} == {"total": "number", "items": "table", "items.qty": "number"}
    assert [tuple(r.operands) for r in rel.where("target = 'total'").collect()] == [("a", "b")]
    assert S.resolve_specs(spark)[0].count() == 0 and S.resolve_specs(spark, "receipt")[0].count() == 6
    for bad in ({"a": 1}, {"a": "nothing"}, {"a": {"proof": {"sum": ["x"]}}}, {"a": {"proof": {"ratio": ["x", "y"]}}}, {"a": {"aliases": ["x"]}}, {"a": {"checksum": "crc"}}, {"a": {"pattern": "("}}, {"a": {"kind": "id"}}, {1: "id"}, "no/such/file"):
        with pytest.raises(S.SpecError):
            S.resolve_specs(spark, bad)
    with pytest.raises(TypeError):
        S.resolve_specs(spark, 5)


def test_assertions_from_json(spark):
    j = '{"total": 5, "who": {"value": "Ann", "quote": "for Ann"}, "tags": ["a", "b"], "items": [{"qty": "2"}]}'
    got = {r.name: (r.value, r.quote) for r in L.assertions_of(spark.createDataFrame([(1, j), (2, "not json")], "doc_id long, extraction string")).collect()}
    assert got == {"total": ("5", None), "who": ("Ann", "for Ann"), "tags[0]": ("a", None), "tags[1]": ("b", None), "items[0].qty": ("2", None)}


def test_segment_store(spark, tmp_path):
    store = L.SegmentStore(spark, str(tmp_path / "segments"))
    docs = spark.createDataFrame([("1", "a b"), ("2", "c")], "doc_id string, text string")
    assert store.missing(docs).count() == 2
    store.add(L.segments_of(docs.where("doc_id = '1'")))
    assert [r.doc_id for r in store.missing(docs).collect()] == ["2"]
