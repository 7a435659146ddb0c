import json
import math

import pytest
from pyspark.sql import functions as F

from tracewell import cli
from tracewell.functions import geometry as G
from tracewell.functions import registry
from tracewell.models import adapters as A
from tracewell.operators import rescue
from tracewell.operators.verify import reread_agrees, with_rereads
from tracewell.plans import lab
from tracewell.sinks import payload, pictures, tables
from tracewell.sources import files
from tracewell.sources.layout import SegmentStore, segments_of
from tracewell.streaming import runs

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_affine_maps(spark):
    w, h, x, y = (F.lit(v) for v in (200.0, 100.0, 30.0, 20.0))
    at = lambda m: tuple(one(spark, G.moved(m, x, y)))
    assert [at(G.turned(F.lit(k), w, h)) for k in range(5)] == [(30, 20), (20, 170), (170, 80), (80, 30), (30, 20)]
    assert [at(G.uprighted(F.lit(k), w, h)) for k in range(1, 9)] == [(30, 20), (170, 20), (170, 80), (30, 80), (20, 30), (80, 30), (80, 170), (20, 170)]
    there = G.chained(F.array(G.scaled(F.lit(2.0), F.lit(3.0)), G.turned(F.lit(1), F.lit(400.0), F.lit(300.0))))
    assert at(there) == (60, 340) and at(G.followed(there, G.inverted(there))) == (30, 20)
    assert one(spark, G.inverted(G.scaled(F.lit(0.0), F.lit(1.0)))) is None
    assert tuple(one(spark, G.moved_box(G.turned(F.lit(1), w, h), G.box(x, y, x + 10, y + 5)))) == (20, 160, 25, 170)
    assert tuple(one(spark, G.flipped(G.box(x, y, x + 10, y + 5), h))) == (30, 75, 40, 80)


def test_skew_glyphs_and_sizes(spark):
    quad = lambda a: F.array(*[F.struct(F.lit(px).alias("x"), F.lit(py).alias("y")) for px, py in ((0.0, 0.0), (100.0, 100 * math.tan(a)), (100.0, 100 * math.tan(a) + 10), (0.0, 10.0))])
    assert one(spark, G.baseline_angle(quad(0.05))) == pytest.approx(0.05)
    skew = lambda *a: one(spark, G.page_skew(F.array(*[F.lit(v) for v in a])))
    assert skew(0.1, 0.02, 0.05, 0.06) == 0.06 and skew(0.1, 0.1) == 0 and skew(0.001, 0.001, 0.002) == 0 and skew(1.0, 1.0, 1.0) == 0
    edges = one(spark, G.char_edges(F.lit("im A")))
    assert edges == pytest.approx([0, 0.45 / 3.35, 1.9 / 3.35, 2.35 / 3.35, 1])
    size = lambda a, b: tuple(one(spark, G.ocr_size(F.lit(a), F.lit(b))))
    assert size(1000, 800) == (992, 800, False) and size(100, 5000) == (736, 5024, True) and size(5000, 4000) == (4160, 3328, False)
    assert one(spark, G.ocr_pixels(F.lit(368), F.lit(1000))) == 368 * 1000 * 4 and one(spark, G.ocr_pixels(F.lit(0), F.lit(9))) == 0
    steps = F.array(*[F.lit(v) for v in (0, 5, 5, 0, 5, 7, 7)])
    assert [tuple(x) for x in one(spark, G.ctc_collapse(steps))] == [(5, 1), (5, 4), (7, 5)]
    corners = lambda w, h: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (w, 0), (w, h), (0, h))])
    half = F.array(F.struct(F.lit(0.5).alias("start"), F.lit(1.0).alias("end")))
    assert tuple(one(spark, G.char_slices(corners(100, 10), half))[0]) == (50, 0, 100, 10) and tuple(one(spark, G.char_slices(corners(10, 100), half))[0]) == (0, 50, 10, 100)


@pytest.mark.parametrize(
    ("ftype", "evidence", "reread", "agrees"),
    [
        ("number", "1 234,50", "1 234,50 EUR", True), ("number", "88,53", "53 88", True), ("number", "68,70", "68", True), ("number", "240,00", "20,00", False), ("number", "12", "21", False),
        ("date", "03.05.2024", "on 03.05.2024", True), ("date", "03.05.2024", "2024 05 03", True), ("date", "03.05.2024", "03.05", True), ("id", "INV-77001", "INV77001 x", True), ("id", "INV-77001", "INV-77002", False),
        ("text", "TSOVES HAVEN", "TS OVES HAVNE", True), ("text", "Anna Long", "Long, the Anna of", True), ("text", "Anna Long", "Bert Short", False), ("text", "", "x", False),
    ],
)
def test_rereads(spark, ftype, evidence, reread, agrees):
    assert one(spark, reread_agrees(F.lit(ftype), F.lit(evidence), F.lit(reread))) is agrees


def test_rereads_change_only_unproven_fields(spark):
    r = spark.createDataFrame([(1, k, "text", "Anna Long", "verified", p, []) for k, p in enumerate((None, None, "checksum", None))], "doc_id long, field_ord int, ftype string, evidence string, status string, proof string, notes array<string>")
    again = spark.createDataFrame([(1, 0, "Anna Long"), (1, 1, "no such"), (1, 2, "no such")], "doc_id long, field_ord int, reread string")
    assert [(x.status, len(x.notes)) for x in with_rereads(r, again).orderBy("field_ord").collect()] == [("verified", 1), ("low_confidence", 1), ("verified", 0), ("verified", 0)]


def test_payloads_and_pictures(spark):
    r = spark.createDataFrame([(1, 0, "total", "1", "verified", float("nan"), 0, (0.1, 0.1, 0.5, 0.2), "1"), (1, 1, "who", "<b>Ann</b>", "not_found", 0.0, None, None, None)], f"doc_id long, field_ord int, name string, value string, status string, confidence double, page int, bbox {BOX}, evidence string")
    meta = spark.createDataFrame([(1, "a.pdf", {"pages": "1", "_image": "x"})], "doc_id long, source string, meta map<string,string>")
    p = payload.payloads(r, meta)
    d = json.loads(p.first().json)
    assert d["schema"] == 1 and d["source"] == "a.pdf" and d["meta"] == {"pages": "1"} and d["summary"] == {"verified": 1, "not_found": 1} and list(d["fields"]) == ["total", "who"]
    assert "confidence" not in d["fields"]["total"] or d["fields"]["total"]["confidence"] is None
    back = {x.name: x for x in payload.from_payloads(p.withColumn("json", F.replace("json", F.lit('"schema":1'), F.lit('"schema":1,"later":{"x":1}')))).collect()}
    assert back["total"].bbox.x1 == 0.5 and back["who"].value == "<b>Ann</b>" and payload.from_payloads(spark.sql("SELECT 1L doc_id, 'junk' json")).count() == 0
    svg = pictures.overlay_svg([{"name": n, **f} for n, f in d["fields"].items()], 100, 200)
    assert svg.count("<rect") == 2 and "NOT FOUND" in svg and "&lt;b&gt;" in svg and "<b>" not in svg
    page = pictures.viewer_html(p.first().json)
    assert "\\u003cb>Ann" in page and "<b>Ann" not in page and '"meta"' not in page


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 1)], "id int, v string, p int")
    new = spark.createDataFrame([(2, "B", 0), (None, "C", 1), (5, "e", 1)], "id int, v string, p int")
    assert sorted((r.v, r.id or 0) for r in tables.upserted(old, new, ["id"]).collect()) == [("B", 2), ("C", 0), ("a", 1), ("e", 5)]


def test_models(spark):
    A.register_family("fake-", lambda model, **s: lambda request: (200, {}, f'Sure {{"a": "{model}"}}'))
    assert A.ask(A.get_transport("fake-1"), {}, {"a": {}, "b": {}}) == {"a": "fake-1", "b": None}
    with pytest.raises(ValueError, match="no model family"):
        A.get_transport("other")
    said, waits = iter([(429, {"retry-after": "90"}, ""), (503, {}, ""), (200, {}, "no json"), (200, {}, '{"a": 1}')]), []
    assert A.ask(lambda r: next(said), {}, {"a": {}}, waits.append) == {"a": 1} and waits == [60.0, 2.0]
    for answers in ([(500, {}, "")] * 4, [(401, {}, "no")], [(200, {}, "x"), (200, {}, "y")]):
        with pytest.raises(A.ModelError):
            A.ask(lambda r, it=iter(answers): next(it), {}, {}, lambda s: None)
    for url in ("https://x.io", "http://localhost:1", "http://127.0.0.1"):
        A.check_endpoint(url, "key")
    A.check_endpoint("http://x.io", None)
    with pytest.raises(ValueError, match="https"):
        A.check_endpoint("http://localhost.x.io", "key")
    asked = A.prompt({"total": {"type": "number"}, "items": {"type": "table", "columns": {"qty": {}}}}, "TEXT", "more")
    assert "- total: number" in asked and "qty" in asked and asked.endswith("<<<DOCUMENT>>>\nTEXT\n<<<END DOCUMENT>>>") and "more" in asked
    assert A.answer_shape({"items": {"columns": {"qty": {}}}})["properties"]["items"]["items"]["required"] == ["qty"]
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in A.extract(docs, lambda: lambda request: (200, {}, '{"a": "v"}') if "x" in request["prompt"].splitlines() else (400, {}, "bad"), {"a": {}}).collect()}
    assert json.loads(got[1].extraction) == {"a": "v"} and got[2].extraction is None and "400" in got[2].error
    pages = spark.createDataFrame([(1, k, "textlayer") for k in range(14)] + [(2, k, "ocr" if k == 3 else "textlayer") for k in range(14)] + [(3, 0, None)], "doc_id long, page int, route string")
    sent = {r.doc_id: (r.kind, len(r.pages), r.n_pages) for r in A.model_inputs(pages).collect()}
    assert sent == {1: ("text", 14, 14), 2: ("image", 12, 14), 3: ("image", 1, 1)}


def test_rescue(spark):
    rows = spark.createDataFrame([(1, 0, 0, False, "Supplier: Anna", 0.0), (1, 0, 1, False, "Anna Long Street", 12.0), (1, 0, 2, False, "none", 24.0), (1, 0, 3, True, "Anna Long Street", 12.0)], "doc_id long, page int, row_ord int, is_cell boolean, text string, top double")
    missing = spark.createDataFrame([(1, 0, "Anna Long Strasse", "Supplier: Anna Long", ["supplier"]), (1, 1, "zzz", None, None), (1, 2, None, "Anna", None)], "doc_id long, field_ord int, value string, quote string, anchors array<string>")
    assert [(r.field_ord, r.row_ord, r.hits) for r in rescue.rescue_lines(missing, rows).orderBy("nth").collect()] == [(0, 0, 2), (0, 1, 2)]
    results = spark.createDataFrame([(1, 0, "not_found", 0.0, None, None, None, None)], f"doc_id long, field_ord int, status string, confidence double, page int, bbox {BOX}, evidence string, notes array<string>")
    found = spark.createDataFrame([(1, 0, 2, 0, (0.0, 0.0, 1.0, 1.0), "late", 1.0), (1, 0, 1, 0, (0.0, 0.0, 1.0, 1.0), "first", 0.8)], f"doc_id long, field_ord int, nth int, page int, bbox {BOX}, evidence string, score double")
    r = rescue.rescued(results, found).first()
    assert (r.status, r.evidence) == ("low_confidence", "first") and r.confidence == pytest.approx(0.56)


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"junk%PDF-1.7 body")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (tmp_path / "c.txt").write_bytes(b"plain")
    (tmp_path / "d").write_bytes(b"")
    docs = files.load_documents(spark, str(tmp_path))
    r = {x.source.rsplit("/", 1)[1]: x for x in docs.collect()}
    assert r["a.pdf"].kind == "pdf" and bytes(r["a.pdf"].content) == b"%PDF-1.7 body" and r["b.png"].kind == "image" and r["c.txt"].error and "d" not in r
    with pytest.raises(files.SourceError, match="empty"):
        files.load_documents(spark, str(tmp_path / "d"))
    with pytest.raises(FileNotFoundError):
        files.load_documents(spark, str(tmp_path / "none"))

    def reader(kind, content):
        if kind == "image":
            raise OSError("no picture")
        return iter([(100, 200, "five words of real text here"), (0, 0, None), (100, 200, "(cid:1) (cid:2) a b c d")])

    pages = sorted((str(p.page), p.width, p.route, p.error) for p in files.read_pages(docs, reader).collect())
    assert pages == [("0", 100, "textlayer", None), ("1", 1, "textlayer", None), ("2", 100, "ocr", None), ("None", None, None, "OSError: no picture")]
    seg = files.recognised(spark.createDataFrame([("1", 0)], "doc_id string, page int"), lambda: lambda p: iter([("hi", 0.0, 0.0, 9.0, 9.0, 0.5)])).first()
    assert (seg.text, seg.conf) == ("hi", 0.5)
    with pytest.raises(ValueError, match="no recogniser"):
        files.recogniser("other")
    frames = spark.createDataFrame([(1, k, 10_000, 9_000) for k in range(6)] + [(2, k, 1, 1) for k in range(52)], "doc_id long, frame int, width int, height int")
    kept = {r.doc_id: (r.n, r.d) for r in files.bounded_frames(frames).groupBy("doc_id").agg(F.count_if("kept").alias("n"), F.max("dropped").alias("d")).collect()}
    assert kept == {1: (4, 2), 2: (50, 2)}
    words = spark.createDataFrame([(1, 0, 0, "ab", 0.0, 0.0, 12.0, 10.0), (1, 0, 1, "zz", 20.0, 0.0, 32.0, 10.0)], "doc_id long, page int, word int, text string, x0 double, top double, x1 double, bottom double")
    chars = spark.createDataFrame([(1, 0, c, x, 0.0, x + 6, 10.0) for c, x in (("b", 6.0), ("a", 0.0), ("z", 20.0))], "doc_id long, page int, text string, x0 double, top double, x1 double, bottom double")
    assert {w.text: w.char_boxes and [b.x0 for b in w.char_boxes] for w in files.words_with_chars(words, chars).collect()} == {"ab": [0.0, 6.0], "zz": None}
    (tmp_path / ".env").write_text("# no\nexport KEY='v'\nSET=new\n")
    into = {"SET": "old"}
    assert files.load_env(tmp_path, into) == tmp_path / ".env" and into == {"SET": "old", "KEY": "v"}


def test_lab(spark):
    ask = lambda *a: one(spark, lab.guard(F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("host", "origin", "token"), a, strict=True)]), ["localhost"], "t"))
    assert [ask("LOCALHOST:80", None, "t"), ask("x.io", None, "t"), ask("localhost", "http://x.io", "t"), ask("localhost", "http://localhost:1", "no"), ask(None, None, "t")] == [None, 421, 403, 401, 421]
    cells = spark.createDataFrame([(1, "items[1].qty", "2"), (1, "items[0].qty", 'say "1"'), (1, "items[0].ean", None), (1, "tags[0]", "x"), (1, "total", "5")], "doc_id long, name string, value string")
    assert json.loads(lab.repin(cells).first().extraction) == {"items": [{"ean": None, "qty": 'say "1"'}, {"qty": "2"}], "tags": ["x"], "total": "5"}


def test_sql_functions(spark):
    registry.register(spark)
    r = spark.sql("SELECT canon('É-1') c, seq_ratio('abcd', 'bcde') s, ean_valid('4006381333931') e, iban_valid('DE89 3704 0044 0532 0130 00') i, iban_valid('DE88370400440532013000') j, bbox_iou(struct(0D, 0D, 1D, 1D), struct(0D, 0D, 1D, 0.5D)) b").first()
    assert (r.c, r.s, r.e, r.i, r.j, r.b) == ("e1", 0.75, True, True, False, 0.5)
    assert [tuple(x) for x in spark.sql("SELECT start, end, exact FROM VALUES ('text', 'Ann', 'for Ann') t(k, v, x), LATERAL match_field(k, v, x)").collect()] == [(4, 7, True)]


def test_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("1", "a"), ("2", "b")], "doc_id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in"))
    told = []
    at = lambda n: str(tmp_path / n)
    runs.run_documents(docs, lambda d: d.selectExpr("doc_id", "upper(text) u"), at("out"), at("states"), at("check"), runs.Progress(lambda *a: told.append(a))).awaitTermination()
    assert {(r.doc_id, r.state) for r in runs.last_states(spark, at("states")).collect()} == {("1", "done"), ("2", "done")} and told == [("run", "start"), ("run", "end")]
    runs.run_documents(docs, lambda d: d.selectExpr("none"), at("out2"), at("states2"), at("check2")).awaitTermination()
    assert {r.state for r in runs.last_states(spark, at("states2")).collect()} == {"error"}
    with pytest.warns(UserWarning, match="no longer told"), runs.Progress(lambda *a: 1 / 0).stage("x"):
        pass
    store = SegmentStore(spark, at("segments"))
    made = []
    for _ in range(2):
        got = runs.with_segments(store, spark.createDataFrame([("1", "a b"), ("2", "c")], "doc_id string, text string"), lambda d: made.append(d.count()) or segments_of(d))
        assert got.count() == 3
    assert made == [2]


def test_command_line(spark, tmp_path, capfd):
    (tmp_path / "t.txt").write_text("Total 12,50\nfor Anna Long")
    (tmp_path / "v.json").write_text('{"total": "12.50", "who": "Anna Long", "other": "Nobody At All"}')
    assert cli.main(["ground", str(tmp_path / "t.txt"), str(tmp_path / "v.json"), "-o", str(tmp_path / "r.json")], spark) == 0
    assert json.loads((tmp_path / "r.json").read_text())["summary"] == {"verified": 2, "not_found": 1}
    assert cli.main(["overlay", str(tmp_path / "r.json")]) == 0 and "<svg" in capfd.readouterr().out
    assert cli.main(["view", str(tmp_path / "r.json"), "-o", str(tmp_path / "v.html")]) == 0 and cli.main(["fields", "receipt"]) == 0
    assert cli.main(["overlay", str(tmp_path / "none")]) == 1 and cli.main(["fields", "none"]) == 1
