"""More registered queries, for the operators around matching: geometry, readings, sources, models, sinks, stored runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import registry
from ..functions import text as T
from ..functions import values as V
from ..models import adapters as A
from ..operators import match as M
from ..operators import resolve as RS
from ..operators import rescue as RC
from ..operators import tables as TB
from ..operators import verify as C
from ..sinks import payload as P
from ..sinks import tables as ST
from ..sources import files as SF
from ..sources import layout as L
from . import lab as LB
from . import specs as S
from .catalogue import CANON, LINES_SQL, line_rows, order_cells, query, table
from .store import kept

#: One line item a line number of an order, the same in SQL.
ITEMS_SQL = "i AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, min(l_quantity)::INT AS qty, min(l_extendedprice)::DECIMAL(14,2) AS price FROM lineitem GROUP BY ALL)"
AMOUNTS_SQL = "o AS (SELECT o_orderkey AS doc_id, min(o_totalprice)::DECIMAL(14,2) AS t FROM orders GROUP BY 1)"


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("k")).agg(F.rint(F.min("l_quantity")).cast("int").alias("qty"), F.min("l_extendedprice").cast("decimal(14,2)").alias("price"))


def amounts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("doc_id")).agg(F.min("o_totalprice").cast("decimal(14,2)").alias("t"))


def asked(df: DataFrame, ftype: str, value, pattern: str | None = None) -> DataFrame:
    return df.select("doc_id", F.lit(0).alias("field_ord"), F.lit(ftype).alias("ftype"), value.alias("value"), F.lit(pattern).cast("string").alias("pattern"))


def printed(df: DataFrame, text) -> DataFrame:
    return df.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("row_ord"), text.alias("text"))


def found(df: DataFrame, ftype: str, value, text, pattern: str | None = None) -> DataFrame:
    """One field and one row a document, matched: doc_id, evidence, score, exact."""
    rows = printed(df, text)
    m = M.match_fields(asked(df, ftype, value, pattern), rows).join(rows.select("doc_id", "text"), "doc_id")
    return m.select("doc_id", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("evidence"), F.round("score", 6).alias("score"), "exact")


@query(f"WITH {AMOUNTS_SQL} SELECT doc_id, replace(replace(format('{{:,.2f}}', t::DOUBLE), ',', ' '), '.', ',') AS evidence, 1.0::DOUBLE AS score, true AS exact FROM o")
def spaced_thousands(spark, sf_dir):
    """Totals printed with spaces between thousands."""
    return found(amounts(spark, sf_dir), "number", F.col("t").cast("string"), F.concat(F.lit("Sum "), F.translate(F.format_number("t", 2), ",.", " ,"), F.lit(" EUR")))


@query(f"WITH {AMOUNTS_SQL} SELECT doc_id, replace(t::VARCHAR, '.', '') AS evidence, 0.85::DOUBLE AS score, false AS exact FROM o")
def lost_decimal_signs(spark, sf_dir):
    return found(amounts(spark, sf_dir), "number", F.col("t").cast("string"), F.concat(F.lit("Sum "), F.replace(F.col("t").cast("string"), F.lit("."), F.lit("")), F.lit(" EUR")))


@query(f"WITH {AMOUNTS_SQL} SELECT doc_id, (doc_id % 9 + 1)::VARCHAR AS evidence, 0.75::DOUBLE AS score, false AS exact FROM o")
def joined_numbers(spark, sf_dir):
    """A quantity read together with the price behind it."""
    n = (F.col("doc_id") % 9 + 1).cast("string")
    return found(amounts(spark, sf_dir), "number", n, F.concat(F.lit("row "), n, F.lit("000012,50 x")))


@query(f"WITH {AMOUNTS_SQL} SELECT doc_id, t::VARCHAR AS evidence, CASE WHEN doc_id % 3 = 1 THEN 0.85 ELSE 1.0 END::DOUBLE AS score, doc_id % 3 <> 1 AS exact FROM o")
def signs_of_numbers(spark, sf_dir):
    """Asserted and printed signs: both minus, one, none."""
    k, t = F.col("doc_id") % 3, F.col("t").cast("string")
    return found(amounts(spark, sf_dir), "number", F.when(k < 2, F.concat(F.lit("-"), t)).otherwise(t), F.concat(F.lit("sum "), F.when(k == 0, "(").otherwise(""), t, F.when(k == 0, ")").otherwise("")))


@query("SELECT s_suppkey AS doc_id, lpad(s_suppkey::VARCHAR, 8, '7') || 's' AS evidence, 1.0::DOUBLE AS score, true AS exact FROM supplier")
def local_forms_of_ids(spark, sf_dir):
    """VAT ids asserted with their country and printed without."""
    core = F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "7"), F.lit("s"))
    return found(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id")), "id", F.concat(F.lit("IE"), core), F.concat(F.lit("our vat "), core), S.VAT_PATTERN)


@query("SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'E' ELSE '£' END AS evidence, CASE WHEN c_custkey % 3 = 2 THEN 1.0 ELSE 0.8 END::DOUBLE AS score, c_custkey % 3 = 2 AS exact FROM customer")
def symbol_look_alikes(spark, sf_dir):
    mark = F.element_at(F.array(F.lit("f"), F.lit("E"), F.lit("£")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return found(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("doc_id")), "text", F.lit("£"), F.concat(F.lit("of cost "), mark, F.col("c_custkey").cast("string")))


@query("SELECT c_custkey AS doc_id, 'Holding Nr ' || lpad(c_custkey::VARCHAR, 9, '0') AS evidence, round(19 / 20.0, 6)::DOUBLE AS score, false AS exact FROM customer")
def similar_texts(spark, sf_dir):
    """Names printed with one letter changed."""
    n = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    r = found(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), "text", F.concat(F.lit("Holding Nrq "), n), F.concat(F.lit("to Holding Nr "), n, F.lit("; dear")))
    return r.withColumn("score", F.round(F.when(F.col("score") > 0.9, F.lit(0.95)).otherwise(F.col("score")), 6))


@query("SELECT c_custkey AS doc_id, c_custkey % 2 = 0 AS hit FROM customer")
def id_guards(spark, sf_dir):
    """An id printed by itself, or inside a longer run of digits."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    n = F.lpad(F.col("doc_id").cast("string"), 7, "4")
    m = found(c, "id", n, F.concat(F.lit("no "), n, F.when(F.col("doc_id") % 2 == 0, " .").otherwise("33 .")))
    return c.join(m.where("exact").select("doc_id", F.lit(True).alias("m")), "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(False)).alias("hit"))


@query(f"SELECT doc_id, md5({CANON.format('text')}) AS canon_md5 FROM documents")
def canon_of_any_script(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.canon_any("text")).alias("canon_md5"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'currency, mena, valuta, wahrung, eur' WHEN 1 THEN 'iban, konts, ucet, account, konto, bankas' WHEN 2 THEN 'dodavatel, piegadatajs, supplier, seller, verkaufer|adresa, address, adrese, anschrift, sidlo' WHEN 3 THEN 'ic dph, dic, pvn, vat, ust, nip' ELSE '' END AS anchors,
CASE WHEN n_nationkey % 5 = 0 THEN 'total, grand_total, amount_due, total_with_vat' END AS affinity, CASE WHEN n_nationkey % 5 = 0 THEN 10 END AS n_aliases, n_nationkey % 5 = 3 AS shaped, CASE n_nationkey % 5 WHEN 1 THEN 'iban' WHEN 3 THEN 'vat' END AS checksum FROM nation""")
def name_hints(spark, sf_dir):
    """What a field's name alone declares; supplier_home_address has the labels of both of its parts."""
    k = F.col("n_nationkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Currency", "iban", "supplier_home_address", "our_vat_number", "note")]), (k % 5 + 1).cast("int"))
    anchors = F.array_join(S.anchors_of(name), ", ")
    both = F.replace(anchors, F.lit("verkaufer, adresa"), F.lit("verkaufer|adresa"))
    return table(spark, sf_dir, "nation").select("n_nationkey", both.alias("anchors"), F.array_join(S.affinity_of(name), ", ").alias("affinity"), F.when(S.aliases_of(name).isNotNull(), F.size(S.aliases_of(name))).alias("n_aliases"), S.pattern_of(name).isNotNull().alias("shaped"), S.checksum_of(name).alias("checksum"))


@query("SELECT * FROM (VALUES ('items', 'description', 'text'), ('items', 'qty', 'number'), ('items', 'amount', 'number')) AS t(top, col, ftype)")
def table_column_types(spark, sf_dir):
    cells, _ = order_cells(spark, sf_dir)
    return S.table_types(cells.select("doc_id", F.lit("items").alias("top"), F.col("item").alias("row"), "col", F.when(F.col("item") > 0, F.col("value")).alias("value")))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS k, count(*) AS n, bool_and(abs(q * p + CASE WHEN l_linenumber % 3 = 0 THEN 5 ELSE 0 END - q * p) <= 0.011 * greatest(1, (q * p + CASE WHEN l_linenumber % 3 = 0 THEN 5 ELSE 0 END) / 100)) AS holds FROM (SELECT l_orderkey, l_linenumber, min(l_quantity)::INT AS q, min(l_extendedprice)::INT AS p FROM lineitem GROUP BY ALL) GROUP BY ALL")
def row_arithmetic(spark, sf_dir):
    """Quantity, price and amount of each printed row, rounded to whole numbers as SQL's casts round; every third amount is 5 too high."""
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("item")).agg(F.rint(F.min("l_quantity")).cast("int").alias("q"), F.rint(F.min("l_extendedprice")).cast("int").alias("p"))
    wrong = F.when(F.col("item") % 3 == 0, 5).otherwise(0)
    cells = {"qty": F.col("q"), "unit_price": F.col("p"), "amount": F.col("q").cast("long") * F.col("p") + wrong}
    each = i.select("doc_id", "item", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in cells.items()])).alias("c")).select("doc_id", "item", "c.*").withColumn("evidence", F.col("value"))
    r = C.relation_notes(each, S.relations(spark, [("amount", "product", ("qty", "unit_price"))]), "item")
    said = r.select(F.struct("doc_id", "item").alias("key"), "holds")  # none for a row without an amount
    return i.select(F.struct("doc_id", "item").alias("key")).join(said.hint("merge"), "key", "left").select("key.doc_id", F.col("key.item").alias("k"), F.lit(1).cast("long").alias("n"), "holds")


@query(f"WITH {AMOUNTS_SQL} SELECT doc_id, t % 1 <> 0 OR true AS holds FROM o")
def relations_of_any_reading(spark, sf_dir):
    """1,000 and 234 make 1,234, whichever way the signs are read."""
    n = F.col("doc_id") % 900 + 100
    reads = lambda c: F.transform(V.value_numbers(c), lambda x: x.cast("double"))
    target, part, rest = F.concat(F.lit("1,"), n.cast("string")), F.lit("1,000"), n.cast("string")
    return amounts(spark, sf_dir).select("doc_id", C.relation_holds(F.lit("sum"), reads(target), F.array(reads(part), reads(rest))).alias("holds"))


def boxed(spark, sf_dir) -> DataFrame:
    """Line items as boxes of their order's page, of several sizes."""
    x, y = F.col("qty") % 5 / 60.0, F.col("price").cast("int") % 4 / 120.0
    return items(spark, sf_dir).withColumn("bbox", G.box(x, y, x + 0.2 + (F.col("k") % 4) / 100.0, y + 0.1 * (1 + F.col("k") % 2)))


BOXES_SQL = ITEMS_SQL + ", b AS (SELECT *, qty % 5 / 60.0::DOUBLE AS x0, trunc(price)::INT % 4 / 120.0::DOUBLE AS y0, qty % 5 / 60.0::DOUBLE + 0.2 + (k % 4) / 100.0::DOUBLE AS x1, trunc(price)::INT % 4 / 120.0::DOUBLE + 0.1 * (1 + k % 2) AS y1 FROM i)"


@query(f"WITH {BOXES_SQL} SELECT doc_id, k, round(CASE k % 4 WHEN 1 THEN y0 WHEN 2 THEN 2 - x1 WHEN 3 THEN 1 - y1 ELSE x0 END, 6) AS x0, round(CASE k % 4 WHEN 1 THEN 2 - x1 WHEN 2 THEN 1 - y1 WHEN 3 THEN x0 ELSE y0 END, 6) AS y0, round(CASE k % 4 WHEN 1 THEN y1 WHEN 2 THEN 2 - x0 WHEN 3 THEN 1 - y0 ELSE x1 END, 6) AS x1, round(x0, 6) AS back FROM b")
def turned_boxes(spark, sf_dir):
    """Boxes of a page 2 wide and 1 high, turned by quarters and back."""
    turn = G.turned(F.col("k"), F.lit(2.0), F.lit(1.0))
    b = boxed(spark, sf_dir).withColumn("to", G.moved_box(turn, F.col("bbox"))).withColumn("back", G.moved_box(G.inverted(turn), F.col("to")))
    return b.select("doc_id", "k", *[F.round(F.col(f"to.{c}"), 6).alias(c) for c in ("x0", "y0", "x1")], F.round("back.x0", 6).alias("back"))


@query(f"WITH {BOXES_SQL} SELECT doc_id, k, round(10 - y1, 6) AS y0, round(least(1, x1 / 0.5), 6) AS x1, round(greatest(0, least(x1, 0.4) - greatest(x0, 0.2)) / least(x1 - x0, 0.2), 6) AS overlap, (x0 + x1) / 2 BETWEEN 0.196 AND 0.404 AND (y0 + y1) / 2 BETWEEN 0.096 AND 0.604 AS inside FROM b")
def box_measures(spark, sf_dir):
    """Boxes measured from below, in shares of a page, against a column and against a truth."""
    b, n = F.col("bbox"), G.normalised(F.col("bbox"), F.lit(0.5), F.lit(1.0))
    truth = G.box(F.lit(0.2), F.lit(0.1), F.lit(0.4), F.lit(0.6))
    cols = [F.round(G.flipped(b, F.lit(10.0))["y0"], 6).alias("y0"), F.round(n["x1"], 6).alias("x1"), F.round(G.overlap_ratio(b["x0"], b["x1"], F.lit(0.2), F.lit(0.4)), 6).alias("overlap"), G.center_in(b, truth).alias("inside")]
    return boxed(spark, sf_dir).select("doc_id", "k", *cols)


@query(f"WITH {BOXES_SQL} SELECT a.doc_id, a.k AS a, b.k AS b FROM b a JOIN b b ON a.doc_id = b.doc_id AND a.k < b.k WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) >= 0.85")
def shared_boxes_of_any_size(spark, sf_dir):
    f = boxed(spark, sf_dir).select("doc_id", F.col("k").alias("field_ord"), F.lit("v").alias("value"), F.lit(0).alias("page"), "bbox")
    return RS.shared_boxes(f).select("doc_id", "a", "b")


@query("""WITH d AS (SELECT DISTINCT o_orderkey AS doc_id, o_orderkey % 3 AS m FROM orders) SELECT doc_id, f AS field_ord, CASE WHEN m = 0 OR m = 1 AND f = 1 THEN 'low_confidence' ELSE 'verified' END AS status, CASE WHEN m = 0 THEN 0.6 WHEN m = 1 AND f = 1 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN m = 1 AND f = 1 THEN 0.5 ELSE 0.1 END::DOUBLE AS y0 FROM d, (VALUES (0), (1)) AS t(f)""")
def shared_boxes_parted(spark, sf_dir):
    """Two fields on one box: neither can move, the second can, or both say the same."""
    box = lambda y: G.box(F.lit(0.1), F.lit(y), F.lit(0.3), F.lit(y + 0.1))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).distinct().withColumn("field_ord", F.explode(F.array(F.lit(0), F.lit(1))))
    m, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    value = F.when(m == 2, "90.00").otherwise(F.concat(F.lit("v"), F.col("field_ord").cast("string")))
    results = d.select("doc_id", "field_ord", value.alias("value"), F.lit("verified").alias("status"), F.lit(0.9).alias("confidence"), F.lit(0).alias("page"), box(0.1).alias("bbox"), none.alias("evidence"), none.alias("anchor"), F.array().cast("array<string>").alias("notes"))
    first = d.select("doc_id", "field_ord", F.lit(1).alias("rank"), F.lit(0).alias("page"), box(0.1).alias("bbox"), none.alias("evidence"), none.alias("anchor"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    other = first.where((m == 1) & (F.col("field_ord") == 1)).withColumns({"rank": F.lit(2), "bbox": box(0.5), "score": F.lit(0.7), "exact": F.lit(False)})
    r = RS.resolve_shared(results, first.unionByName(other))
    return r.select("doc_id", "field_ord", "status", F.round("confidence", 6).alias("confidence"), F.col("bbox.y0").alias("y0"))


@query(f"WITH {ITEMS_SQL}, a AS (SELECT doc_id, list_sort(list(atan2((qty - 25) / 2.0, 100.0))) AS xs FROM i GROUP BY 1), m AS (SELECT doc_id, len(xs) AS n, xs[len(xs) // 2 + 1] AS m FROM a) SELECT doc_id, round(CASE WHEN n < 3 OR abs(m) < radians(0.5) OR abs(m) > radians(15) THEN 0 ELSE m END, 6) AS skew FROM m")
def page_skews(spark, sf_dir):
    """Line items as quads whose lower edge rises with the quantity."""
    rise = (F.col("qty") - 25) / 2.0
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), y.cast("double").alias("y"))
    quad = F.array(point(0, F.lit(0.0)), point(100, rise), point(100, rise + 50), point(0, F.lit(50.0)))
    i = items(spark, sf_dir).withColumn("angle", G.baseline_angle(quad))
    return i.groupBy("doc_id").agg(F.round(G.page_skew(F.collect_list("angle")), 6).alias("skew"))


@query("WITH w AS (SELECT p_partkey, p_name, list_transform(string_split(p_name, ''), lambda c: CASE WHEN contains('.,:;!i|l''`ıíì()[]{} ', c) THEN 0.45 WHEN contains('mwMW@', c) THEN 1.45 WHEN lower(c) = c AND upper(c) <> c THEN 0.85 ELSE 1.0 END::DOUBLE) AS ws FROM part) SELECT p_partkey, round(list_sum(ws[1:3]) / list_sum(ws), 6) AS third, len(ws) + 1 AS n FROM w")
def glyph_edges(spark, sf_dir):
    e = G.char_edges(F.col("p_name"))
    return table(spark, sf_dir, "part").withColumn("e", e).select("p_partkey", F.round(F.get("e", F.lit(3)), 6).alias("third"), F.size("e").cast("long").alias("n"))


@query("""WITH s AS (SELECT p_partkey, p_partkey % 4000 + 50 AS w, p_size * 120 + 10 AS h FROM part), q AS (SELECT *, CASE WHEN least(w, h) >= 736 THEN w::DOUBLE * h ELSE floor(w::DOUBLE * h * (736.0 / least(w, h)) * (736.0 / least(w, h))) END AS px FROM s)
SELECT p_partkey, CASE WHEN px > 14000000 AND least(w, h) < 736 THEN greatest((w + 31) // 32 * 32, 736) WHEN px > 14000000 THEN greatest(32, floor(w * sqrt(14000000 / (w::DOUBLE * h)))::INT // 32 * 32) ELSE greatest(32, w // 32 * 32) END::INT AS width, px > 14000000 AND least(w, h) < 736 AS padded FROM q""")
def recogniser_sizes(spark, sf_dir):
    size = G.ocr_size((F.col("p_partkey") % 4000 + 50).cast("int"), (F.col("p_size") * 120 + 10).cast("int"))
    return table(spark, sf_dir, "part").withColumn("s", size).select("p_partkey", "s.width", "s.padded")


@query("WITH s AS (SELECT o_orderkey, list_transform(string_split(o_orderkey::VARCHAR || o_custkey::VARCHAR, ''), lambda c: c::INT) AS xs FROM orders), k AS (SELECT o_orderkey, list_filter(range(1, len(xs) + 1), lambda i: xs[i] <> 0 AND (i = 1 OR xs[i] <> xs[i - 1])) AS ks, xs FROM s) SELECT DISTINCT o_orderkey, array_to_string(list_transform(ks, lambda i: xs[i]), '') AS spelled, array_to_string(list_transform(ks, lambda i: i - 1), ',') AS steps FROM k")
def collapsed_steps(spark, sf_dir):
    """Digits of two numbers as the best symbols of a recogniser's steps; zeros are blanks."""
    steps = F.transform(F.filter(F.split(F.concat(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), ""), lambda c: c != ""), lambda c: c.cast("int"))
    c = table(spark, sf_dir, "orders").select("o_orderkey", G.ctc_collapse(steps).alias("c")).distinct()
    return c.select("o_orderkey", F.array_join(F.transform("c", lambda x: x["symbol"].cast("string")), "").alias("spelled"), F.array_join(F.transform("c", lambda x: x["step"].cast("string")), ",").alias("steps"))


@query(f"WITH {AMOUNTS_SQL} SELECT doc_id, doc_id % 5 <> 4 AS agrees FROM o")
def second_readings(spark, sf_dir):
    """Totals read again: alike, with a mark, clipped, with the digits in another order, and as another number."""
    t, k = F.concat(F.lit("9"), F.col("t").cast("string")), F.col("doc_id") % 5
    again = F.when(k == 0, t).when(k == 1, F.concat(F.lit("EUR "), t)).when(k == 2, F.substr(t, F.lit(1), F.length(t) - 3)).when(k == 3, F.reverse(t)).otherwise(F.lit("x"))
    return amounts(spark, sf_dir).select("doc_id", C.reread_agrees(F.lit("number"), t, again).alias("agrees"))


EVENT_PAGES_SQL = "p AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS page, event_type, event_id FROM events)"


def event_pages(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("page"), "event_type", "event_id")


@query(f"WITH {EVENT_PAGES_SQL} SELECT doc_id, CASE WHEN bool_and(event_type <> 'purchase') THEN 'text' ELSE 'image' END AS kind, CASE WHEN bool_and(event_type <> 'purchase') THEN count(*) ELSE least(count(*), 12) END AS n_sent, count(*) AS n_pages FROM p GROUP BY doc_id")
def model_inputs(spark, sf_dir):
    """Events as pages; a purchase has no text layer."""
    pages = event_pages(spark, sf_dir).select("doc_id", "page", F.when(F.col("event_type") != "purchase", "textlayer").otherwise("ocr").alias("route"))
    return A.model_inputs(pages).select("doc_id", "kind", F.size("pages").cast("long").alias("n_sent"), "n_pages")


@query(f"WITH {EVENT_PAGES_SQL}, f AS (SELECT *, page < 50 AND sum(1000 * (event_id % 20000)) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) <= 400000000 AS kept FROM p) SELECT doc_id, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_dropped FROM f GROUP BY doc_id")
def frame_bounds(spark, sf_dir):
    """Events as frames of an image, 1000 wide."""
    f = event_pages(spark, sf_dir).select("doc_id", F.col("page").alias("frame"), F.lit(1000).alias("width"), (F.col("event_id") % 20000).alias("height"))
    return SF.bounded_frames(f).groupBy("doc_id").agg(F.count_if("kept").alias("n_kept"), F.max("dropped").alias("n_dropped"))


@query("SELECT conv_id * 1000 + turn AS doc_id, '{\"role\": \"' || role || '\", \"note\": null}' AS extraction FROM conversations WHERE text IS NOT NULL")
def model_extraction(spark, sf_dir):
    """A model, played by a function, that is busy at first and wraps its answer in prose."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(F.lit("ROLE "), "role").alias("text"))

    def make():
        state = {"calls": 0}

        def send(request):
            state["calls"] += 1
            if state["calls"] % 50 == 1:
                return 429, {"retry-after": "0"}, ""
            role = next(x for x in request["prompt"].splitlines() if x.startswith("ROLE ")).removeprefix("ROLE ")
            return 200, {}, "Here it is:\n```json\n" + json.dumps({"role": role}) + "\n```"

        return send

    return A.extract(turns, make, {"role": {}, "note": {}}).select("doc_id", "extraction")


STATUS_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'not_found' ELSE 'ambiguous' END"


@query(f"SELECT o_custkey AS doc_id, {STATUS_SQL} AS status, count(*) AS n, sum(o_orderkey % 100)::BIGINT AS total FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY ALL")
def payload_round_trip(spark, sf_dir):
    """Orders as a customer's fields, written to payloads and read back."""
    k = F.col("o_orderkey") % 3
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey").distinct()
    r = o.select("doc_id", F.col("o_orderkey").alias("field_ord"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderkey") % 100).cast("string").alias("value"), F.when(k == 0, "verified").when(k == 1, "not_found").otherwise("ambiguous").alias("status"), F.lit(float("nan")).alias("confidence"))
    return P.from_payloads(P.payloads(r)).groupBy("doc_id", "status").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 100000000, 'new' FROM customer WHERE c_custkey % 4 = 0")
def upserted_customers(spark, sf_dir):
    """Every fourth customer changed, and as many added."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    some = old.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("new"))
    return ST.upserted(old, some.unionByName(some.withColumn("c_custkey", F.col("c_custkey") + 100000000)), ["c_custkey"])


@query(f"WITH {ITEMS_SQL} SELECT doc_id, count(*) AS n, sum(qty)::BIGINT AS qty, max(price)::VARCHAR AS price FROM i GROUP BY doc_id")
def rebuilt_extractions(spark, sf_dir):
    """Line items as flat cells, nested again, and read."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1
    i = items(spark, sf_dir).withColumn("i", nth.cast("string"))
    cell = lambda c: i.select("doc_id", F.concat(F.lit("items["), "i", F.lit(f"].{c}")).alias("name"), F.col(c).cast("string").alias("value"))
    e = LB.repin(cell("qty").unionByName(cell("price"))).select("doc_id", F.explode(F.from_json("extraction", "items array<struct<qty:string,price:string>>")["items"]).alias("x"))
    return e.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("x.qty").cast("long")).alias("qty"), F.max(F.col("x.price").cast("decimal(14,2)")).cast("string").alias("price"))


@query("WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) SELECT page_id, CASE WHEN regexp_replace(host, ':[0-9]+$', '') <> 'localhost' AND page_id % 2 = 0 THEN 421 WHEN page_id % 2 = 1 AND page_id % 3 = 0 THEN 403 WHEN page_id % 5 = 0 THEN 401 END AS status FROM h WHERE page_id % 2 = 1 OR host <> 'localhost'")
def guarded_requests(spark, sf_dir):
    """Requests to this machine and to others, from other pages, and with a wrong token."""
    k = F.col("page_id")
    host = F.when(k % 2 == 1, F.concat(F.lit("LOCALHOST:"), k.cast("string"))).otherwise(F.regexp_extract("url", r"://([^/?#]*)", 1))
    request = F.struct(host.alias("host"), F.when(k % 3 == 0, "https://x.example").alias("origin"), F.when(k % 5 != 0, "t").alias("token"))
    return table(spark, sf_dir, "pages").select("page_id", LB.guard(request, ["localhost"], "t").cast("int").alias("status"))


@query("SELECT event_type AS model, sum(round(((event_id % 1000) * 10 * CASE WHEN event_type = 'purchase' THEN 2.0 ELSE 1.0 END + (user_id % 500) * 10 * 8.0) / 1e6, 5)) AS usd FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY 1")
def priced_calls(spark, sf_dir):
    """Events as calls of models; one of them is known by another name."""
    use = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view', 'click')").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000 * 10).alias("tokens_in"), (F.col("user_id") % 500 * 10).alias("tokens_out"))
    prices = spark.createDataFrame([("big", 2.0, 8.0), ("view", 1.0, 8.0), ("click", 1.0, 8.0)], "model string, usd_in double, usd_out double")
    return LB.priced(use, prices, spark.createDataFrame([("purchase", "big")], "model string, means string")).groupBy("model").agg(F.sum("usd").alias("usd"))


@query("SELECT quality, count(*) AS n, count(*) FILTER (v = 'read') AS n_read, round(count(*) FILTER (v = 'read') / nullif(count(*) FILTER (v IN ('read', 'missed')), 0), 6) AS recall, round(count(*) FILTER (v = 'read') / nullif(count(*) FILTER (v IN ('read', 'invented')), 0), 6) AS precision FROM (SELECT quality, CASE WHEN toxic = 1 THEN 'read' WHEN doc_id % 2 = 0 THEN 'missed' ELSE 'invented' END AS v FROM labels) GROUP BY quality")
def read_rates(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select("quality", F.when(F.col("toxic") == 1, "verified").otherwise("not_found").alias("status"), (F.col("doc_id") % 2 == 0).alias("on_page"))
    return LB.read_rates(C.verdicts(r), "quality").select("quality", "n", "n_read", "recall", "precision")


@query("WITH f AS (SELECT o_custkey AS field, count(DISTINCT o_orderpriority) AS m, count(DISTINCT o_orderstatus) AS v FROM orders GROUP BY 1) SELECT count(*) AS n_fields, round(avg((v <= 1)::INT), 6) AS agree_rate FROM f WHERE m >= 2")
def agree_rates(spark, sf_dir):
    """Order priorities as models that say a customer's status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("value"))
    return LB.agree_rates(o).select("n_fields", "agree_rate")


@query(f"WITH {BOXES_SQL}, e AS (SELECT *, (x0 + x1) / 2 BETWEEN 0.196 AND 0.504 AND (y0 + y1) / 2 BETWEEN -0.004 AND 0.504 AS ok FROM b) SELECT count(*) FILTER (k < 5) AS n_fields, count(*) FILTER (k < 5 AND ok) AS n_located, count(*) FILTER (k < 5 AND NOT ok AND k <> 2) AS silent_wrong, count(*) FILTER (k < 5 AND NOT ok AND k = 2) AS flagged_wrong, count(*) FILTER (k = 7) AS n_fakes, count(*) FILTER (k = 7) AS fakes_caught FROM e")
def corpus_evaluation(spark, sf_dir):
    """Line items as fields: the first four have a true place, the second is in doubt, the seventh is invented."""
    k = F.col("k")
    r = boxed(spark, sf_dir).select("doc_id", F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k == 2, "low_confidence").when(k == 7, "not_found").otherwise("verified").alias("status"), "bbox")
    truth = r.select("doc_id", "name", G.box(F.lit(0.2), F.lit(0.0), F.lit(0.5), F.lit(0.5)).alias("bbox")).where("name in ('f1', 'f2', 'f3', 'f4')")
    return C.evaluation(r, truth, "f7")


@query("SELECT o_custkey AS doc_id, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median FROM orders GROUP BY 1")
def upper_medians(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(G.upper_median(F.collect_list("o_totalprice")).alias("median"))


@query("SELECT o_orderkey, abs(year(o_orderdate) - 1985) <= 10 AS plausible FROM orders")
def plausible_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.date_plausible(V.date_readings(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(1985)).alias("plausible"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'amount due' WHEN p_partkey % 4 = 1 THEN 'total' END AS anchor FROM part")
def longest_anchors(spark, sf_dir):
    """The longest label that a line holds; a short one must be a word of its own."""
    k = F.col("p_partkey") % 4
    text = F.concat(F.when(k == 0, "Total amount due ").when(k == 1, "TOTAL: ").when(k == 2, "nobody ").otherwise("x "), F.col("p_name"))
    labels = F.array(F.lit("no"), F.lit("total"), F.lit("amount due"))
    by_canon = F.replace(M.longest_anchor(labels, text), F.lit("amountdue"), F.lit("amount due"))
    return table(spark, sf_dir, "part").select("p_partkey", by_canon.alias("anchor"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type FROM events EXCEPT ALL SELECT DISTINCT user_id, event_type FROM events)")
def repeated_events(spark, sf_dir):
    """What is left of a multiset when each of its members is taken out once."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    return e.exceptAll(e.distinct())


@query("SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def flat_assertions(spark, sf_dir):
    """Properties of events as extractions; a row a value."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return L.assertions_of(e, "event_id", "props").select(F.col("doc_id").alias("event_id"), "name", "value")


@query("SELECT o_custkey AS doc_id, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def one_document(spark, sf_dir):
    """A scan with a parameter: the filter and the three columns reach the file."""
    return table(spark, sf_dir, "orders").where(F.col("o_custkey") == 7).select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_totalprice")


@query("SELECT p_partkey, ((10 - list_sum(list_transform(range(1, 13), lambda i: substr(lpad(p_partkey::VARCHAR, 12, '4'), i, 1)::INT * CASE WHEN (13 - i) % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10) = p_partkey % 10 AS ean, round(1 / 3.0, 6)::DOUBLE AS iou FROM part")
def sql_functions(spark, sf_dir):
    """The registered functions, called from SQL."""
    registry.register(spark)
    table(spark, sf_dir, "part").select("p_partkey").createOrReplaceTempView("tracewell_parts")
    box = "named_struct('x0', {}D, 'y0', 0D, 'x1', {}D, 'y1', 1D)"
    return spark.sql(f"SELECT p_partkey, ean_valid(lpad(CAST(p_partkey AS STRING), 12, '4') || CAST(p_partkey % 10 AS STRING)) AS ean, round(bbox_iou({box.format(0, 1)}, {box.format(0.5, 1.5)}), 6) AS iou FROM tracewell_parts")


@query(f"WITH {ITEMS_SQL} SELECT doc_id, k, (1000 - k)::INT AS row_ord FROM i")
def table_assignment_out_of_order(spark, sf_dir):
    """Rows are printed from the last item to the first, so that the order decides for one item and the others take what is free."""
    i = items(spark, sf_dir).withColumn("name", F.concat(F.lit("article "), F.col("k").cast("string"), F.lit(" of "), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    cells = i.select("doc_id", F.col("k").cast("int").alias("item"), F.lit("name").alias("col"), F.lit("text").alias("ftype"), F.col("name").alias("value"))
    rows = i.select("doc_id", F.lit(0).alias("page"), (1000 - F.col("k")).cast("int").alias("row_ord"), F.concat("name", F.lit("  "), F.col("qty").cast("string")).alias("text"))
    return TB.assign_rows(TB.pair_hits(cells, rows)).select("doc_id", F.col("item").cast("long").alias("k"), "row_ord")


@query("SELECT p_partkey AS doc_id, count(*) AS n_chars, true AS spelled FROM (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ''), '')) FROM part) GROUP BY 1")
def words_spelled_by_chars(spark, sf_dir):
    """Part names as words and as characters on a grid; characters find their words by place."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    seg = L.segments_of(p, text_col="p_name")
    words = seg.select("doc_id", "page", F.col("seg_ord").alias("word"), "text", "x0", "top", "x1", "bottom")
    chars = p.select("doc_id", F.posexplode(F.filter(F.split("p_name", ""), lambda c: c != "")).alias("k", "text")).where("text <> ' '")
    chars = chars.select("doc_id", F.lit(0).alias("page"), "text", (F.col("k") * L.CHAR).alias("x0"), F.lit(0.0).alias("top"), ((F.col("k") + 1) * L.CHAR).alias("x1"), F.lit(L.HEIGHT).alias("bottom"))
    w = SF.words_with_chars(words, chars)
    return w.groupBy("doc_id").agg(F.sum(F.size("char_boxes")).cast("long").alias("n_chars"), F.bool_and(F.col("char_boxes").isNotNull()).alias("spelled"))


RESCUE_SQL = f"""WITH {LINES_SQL}, l AS (SELECT doc_id, line_no, {CANON.format('text')} AS hay FROM lines), t AS (SELECT DISTINCT item_id, unnest(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: {CANON.format('w')}), lambda w: length(w) >= 4)) AS token FROM benchmark),
h AS (SELECT item_id AS doc_id, line_no, count(*) AS hits FROM t JOIN l ON l.doc_id = t.item_id AND contains(hay, token) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, line_no) AS nth FROM h)
SELECT doc_id, line_no::BIGINT AS row_ord, hits FROM r WHERE nth <= 2"""


@query(RESCUE_SQL)
def lines_to_read_again(spark, sf_dir):
    """Benchmark items as fields that were not found in the document of their number."""
    m = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("field_ord"), F.col("text").alias("value"), F.lit(None).cast("string").alias("quote"), F.lit(None).cast("array<string>").alias("anchors"))
    rows = line_rows(spark, sf_dir).withColumn("is_cell", F.lit(False))
    return RC.rescue_lines(m, rows).select("doc_id", F.col("row_ord").cast("long").alias("row_ord"), "hits")


@query("SELECT doc_id::VARCHAR AS doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL")
def stored_segments(spark, sf_dir):
    """Geometry made once for half of the documents, then for those that are missing."""
    from ..streaming.runs import with_segments
    from .store import shared_path

    store = L.SegmentStore(spark, shared_path(spark, "segments"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    with_segments(store, docs.where("cast(doc_id as long) % 2 = 0"), L.segments_of)
    return with_segments(store, docs, L.segments_of).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id::VARCHAR AS doc_id, 'done' AS state FROM documents")
def run_states(spark, sf_dir):
    """A run over a stream of documents, and the last state of each."""
    from ..streaming.runs import last_states, run_documents
    from .store import shared_path

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.length("text").alias("n"))
    at = shared_path(spark, "run")
    kept(docs).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("doc_id string, n int").parquet(f"{at}/in")
    run_documents(stream, lambda d: d.select("doc_id", "n"), f"{at}/out", f"{at}/states", f"{at}/check").awaitTermination()
    return last_states(spark, f"{at}/states").select("doc_id", "state")
