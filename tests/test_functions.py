import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import geometry as G
from tracewell.functions import text as T
from tracewell.functions import values as V


def one(spark, values, column):
    return [r.out for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v")).alias("out")).collect()]


def test_canon(spark):
    cases = {"Čé ā!": "cea", "ﬁnance": "finance", "Straße": "strasse", "Счёт № 12345": None, "": ""}
    for v, want in cases.items():
        if want is not None:
            assert one(spark, [v], T.canon) == [want]
    assert T.canon_map("٤٢")[0] == "42" and T.canon_map("Счёт № 12345")[0].endswith("12345")
    text = "Ab ß, ﬁ"
    c, at = T.canon_map(text)
    assert at == sorted(at) and T.canon_map(c)[0] == c


def test_numbers(spark):
    cases = {"146,14": {"146.14"}, "1,234": {"1.234", "1234"}, "1 900,00 Kč": {"1900"}, "50kg": {"50"}, "100,-": {"100"}, "12 kg 34": set(), "(5)": {"-5"}, None: set()}
    got = one(spark, list(cases), V.value_numbers)
    assert [set(g) for g in got] == list(cases.values())


def test_dates(spark):
    cases = {"03/04/2026": [20260304, 20260403], "05-20-2509:56": [20250520], "3 April 2026": [20260403], "no date": [], "31.02.2020": [20200231]}
    assert one(spark, list(cases), V.date_readings) == list(cases.values())


def test_checksums(spark):
    assert one(spark, ["8586024770485", "8586024770486", "12"], V.ean_valid) == [True, False, None]
    assert one(spark, ["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"], V.iban_valid) == [True, False]
    got = one(spark, ["SK73 11OO 0000 0026 2902 8990", "SHORT"], V.iban_check)
    assert got[0].passed and got[0].repaired == "SK7311000000002629028990" and got[1].passed is None
    assert one(spark, ["SK0000000011", "SK0000000012", "XX1", "DE123456789"], V.vat_valid) == [True, False, None, True]


def test_small_strings(spark):
    assert one(spark, ["12", "123", None], T.is_short_number) == [True, False, None]
    assert one(spark, [None, "  ", "x"], T.is_blank) == [True, True, False]
    assert one(spark, ["abcd", "ab"], T.grams) == [["abc", "bcd"], []]
    assert one(spark, ["so: {\"a\": 1} ok", "none", "{bad"], T.salvage_json) == ['{"a": 1}', None, None]


def test_boxes(spark):
    box = lambda *v: G.box(*[F.lit(x) for x in v])
    r = spark.range(1).select(G.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)).alias("a"), G.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("b"), G.normalised(box(-5, 10, 50, 200), F.lit(100.0), F.lit(100.0)).alias("c"), G.upper_median(F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0, 4.0)])).alias("m")).first()
    assert r.a == pytest.approx(1 / 3) and r.b == 0 and tuple(r.c) == (0, 0.1, 0.5, 1) and r.m == 3


def test_fuzzy_spans():
    assert T.fuzzy_spans("xxabcdexx", "abcde", 0.9)[0][:2] == (2, 7)
    assert T.fuzzy_spans("zzzz", "abc", 0.8) == [] and T.fuzzy_spans("", "a", 0.5) == []
    random.seed(1)
    for _ in range(50):
        hay = "".join(random.choices("abc", k=20))
        found = T.fuzzy_spans(hay, hay[3:9], 0.99)
        assert any(a == 3 or hay[a:b] == hay[3:9] for a, b, _ in found)
