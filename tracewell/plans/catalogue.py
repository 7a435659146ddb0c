"""The registered queries, each an operator over its whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import values as V
from ..operators import match as M
from ..operators import rows as R
from ..operators import tables as TB
from ..operators import verify as C
from ..operators.resolve import affinity_pick, shared_boxes, with_aliases
from ..sources import layout as L
from . import specs as S
from .ground import ground

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB's canonical form, for Latin script.
CANON = "regexp_replace(strip_accents(replace(lower({}), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
#: Lines and words of documents on the grid.
LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents straight from their lines: on the grid a line is a row."""
    lines = L.lines_of(table(spark, sf_dir, "documents")).where("trim(text) <> ''")
    indent = F.length("text") - F.length(F.ltrim("text"))
    return lines.select("doc_id", F.lit(0).alias("page"), F.col("line_no").alias("row_ord"), "text", (indent * L.CHAR).alias("x0"), (F.col("line_no") * L.LINE).alias("top"), (F.length(F.rtrim("text")) * L.CHAR).alias("x1"), (F.col("line_no") * L.LINE + L.HEIGHT).alias("bottom"))


ROWS_SQL = LINES_SQL + ", rows AS (SELECT doc_id, line_no AS row_ord, text, (length(text) - length(ltrim(text, ' '))) * 6.0 AS x0, line_no * 12.0 AS top, length(rtrim(text, ' ')) * 6.0 AS x1, line_no * 12.0 + 10.0 AS bottom FROM lines WHERE trim(text, ' ') <> '')"


@query(f"SELECT doc_id, md5({CANON.format('text')}) AS canon_md5, length({CANON.format('text')}) AS n FROM documents")
def canon_documents(spark, sf_dir):
    c = T.canon(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("canon_md5"), F.length(c).alias("n"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no::BIGINT AS line_no, len(list_filter(string_split(text, ' '), lambda w: w <> ''))::BIGINT AS n_words, (length(rtrim(text, ' ')) * 6.0)::DOUBLE AS x1 FROM lines WHERE trim(text, ' ') <> ''")
def layout_rows(spark, sf_dir):
    rows = R.build_rows(L.segments_of(table(spark, sf_dir, "documents"))).where("not is_cell")
    return rows.select("doc_id", (F.col("top") / L.LINE).cast("long").alias("line_no"), F.size("segs").cast("long").alias("n_words"), "x1")


@query(f"WITH {LINES_SQL}, w AS (SELECT doc_id, line_no, text, unnest(string_split(text, ' ')) AS w FROM lines) SELECT doc_id, count(*) AS n_segments, 1.0::DOUBLE AS mean_conf, sum(length(w))::DOUBLE AS score, max(line_no) * 12.0 + 10.0 AS y1 FROM w WHERE w <> '' GROUP BY doc_id")
def page_stats(spark, sf_dir):
    return R.page_stats(L.segments_of(table(spark, sf_dir, "documents"))).select("doc_id", "n_segments", "mean_conf", "score", "y1")


@query()
def row_cells(spark, sf_dir):
    """Two columns on the grid: names left, numbers right; each line splits in two cells."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 40).alias("doc_id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("a"), F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("b")).distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "b", "a")).cast("double")
    o = o.withColumn("y", nth * 12)
    seg = lambda c, x, k: o.select("doc_id", F.lit(0).alias("page"), (F.col("y") * 10 + k).cast("long").alias("seg_ord"), F.col(c).alias("text"), F.lit(x).alias("x0"), F.col("y").alias("top"), (x + F.length(c) * 6.0).alias("x1"), (F.col("y") + 10).alias("bottom"), F.lit(1.0).alias("conf"))
    rows = R.build_rows(seg("a", 0.0, 0).unionByName(seg("b", 400.0, 1)))
    return rows.groupBy("doc_id", "is_cell").agg(F.count("*").alias("n"), F.sum(F.size("segs")).alias("n_segs"))


@query(f"WITH {ROWS_SQL}, n AS (SELECT *, lead(row_ord) OVER w AS r2, lead(text) OVER w AS t2, lead(x0) OVER w AS a2, lead(x1) OVER w AS b2, lead(row_ord, 2) OVER w AS r3, lead(text, 2) OVER w AS t3, lead(x0, 2) OVER w AS a3, lead(x1, 2) OVER w AS b3 FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY row_ord)), " + """
o AS (SELECT *, r2 = row_ord + 1 AND least(x1, b2) - greatest(x0, a2) > 0 AND (least(x1, b2) - greatest(x0, a2)) / least(x1 - x0, b2 - a2) >= 0.5 AS two, r3 = r2 + 1 AND least(b2, b3) - greatest(a2, a3) > 0 AND (least(b2, b3) - greatest(a2, a3)) / least(b2 - a2, b3 - a3) >= 0.5 AS three FROM n)
SELECT doc_id, row_ord::BIGINT AS first_row, 2::BIGINT AS n_rows, md5(text || ' ' || t2) AS text_md5 FROM o WHERE two UNION ALL SELECT doc_id, row_ord, 3, md5(text || ' ' || t2 || ' ' || t3) FROM o WHERE two AND three""")
def merged_rows(spark, sf_dir):
    out = R.merged_rows(line_rows(spark, sf_dir))
    return out.select("doc_id", F.col("first_row").cast("long").alias("first_row"), F.col("n_rows").cast("long").alias("n_rows"), F.md5("text").alias("text_md5"))


#: Items of an automaton.
ITEMS_AT_ONCE = 200_000


def found_passages(spark, sf_dir) -> DataFrame:
    """(item_id, doc_id, line_no, n_lines): benchmark items in documents by canonical containment in one to three lines, the first place with the fewest lines.

    About ITEMS_AT_ONCE items are one automaton that reads each document once and goes to every executor; more items are
    searched in as many blocks.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", T.canon(F.col("text")).alias("needle")).where("needle <> ''")
    blocks = max(1, -(-items.count() // ITEMS_AT_ONCE))
    lines = L.lines_of(table(spark, sf_dir, "documents")).select("doc_id", "line_no", T.canon(F.col("text")).alias("c"))
    docs = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "c"))), lambda x: x["c"]).alias("lines"))

    found = [search_block(docs, items.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == k)) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def search_block(docs: DataFrame, items: DataFrame) -> DataFrame:
    import ahocorasick

    own = [(r.item_id, r.needle) for r in items.collect()]

    def search(it):
        auto: dict[str, list[int]] = {}
        for i, needle in own:
            auto.setdefault(needle, []).append(i)
        a = ahocorasick.Automaton()
        for needle, ids in auto.items():
            a.add_word(needle, (len(needle), ids))
        if auto:
            a.make_automaton()
        for some in it:
            out = []
            for doc, lines_ in zip(some["doc_id"], some["lines"], strict=True):
                ends = pd.Series([len(x) for x in lines_]).cumsum().to_numpy()
                best: dict[int, tuple[int, int]] = {}
                for last, (n, ids) in a.iter("".join(lines_)) if auto else ():
                    first, end = ends.searchsorted([last - n + 1, last], "right")
                    for i in ids:
                        best[i] = min(best.get(i, (4, 0)), (int(end - first) + 1, int(first)))
                out += [(i, doc, line, k) for i, (k, line) in best.items() if k <= 3]
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "line_no", "n_lines"])

    return docs.mapInPandas(search, "item_id long, doc_id long, line_no long, n_lines long")


FOUND_SQL = f"""{LINES_SQL}, c AS (SELECT doc_id, line_no, {CANON.format('text')} AS c FROM lines),
n AS (SELECT doc_id, line_no, c, lead(c) OVER w AS c2, lead(c, 2) OVER w AS c3 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT item_id, {CANON.format('text')} AS needle FROM benchmark),
h AS (SELECT item_id, doc_id, line_no, CASE WHEN contains(c, needle) THEN 1 WHEN contains(c || coalesce(c2, ''), needle) THEN 2 ELSE 3 END AS k FROM n, b WHERE needle <> '' AND contains(c || coalesce(c2, '') || coalesce(c3, ''), needle)),
f AS (SELECT item_id, doc_id, min(k) AS n_lines FROM h GROUP BY ALL),
found AS (SELECT f.item_id, f.doc_id, min(h.line_no)::BIGINT AS line_no, f.n_lines::BIGINT AS n_lines FROM f JOIN h ON f.item_id = h.item_id AND f.doc_id = h.doc_id AND h.k = f.n_lines GROUP BY ALL)"""


@query(f"WITH {FOUND_SQL} SELECT item_id, doc_id, line_no, n_lines, 'verified' AS status FROM found")
def ground_text_exact(spark, sf_dir):
    return found_passages(spark, sf_dir).withColumn("status", F.lit("verified"))


@query(f"WITH {FOUND_SQL} SELECT item_id, 'not_found' AS status FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM found)")
def ground_not_found(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return items.join(found_passages(spark, sf_dir).select("item_id").distinct(), "item_id", "left_anti").withColumn("status", F.lit("not_found"))


@query(f"WITH {FOUND_SQL} SELECT n_lines, count(*) AS n FROM found GROUP BY n_lines")
def ground_status_counts(spark, sf_dir):
    return found_passages(spark, sf_dir).groupBy("n_lines").agg(F.count("*").alias("n"))


@query("SELECT event_id, regexp_full_match(v, '\\d{1,2}') AS short, v IS NULL OR trim(v) = '' AS blank FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '  ' WHEN event_id % 7 = 2 THEN (event_id % 100)::VARCHAR ELSE event_type END AS v FROM events)")
def short_and_blank(spark, sf_dir):
    k = F.col("event_id") % 7
    v = F.when(k == 0, None).when(k == 1, "  ").when(k == 2, (F.col("event_id") % 100).cast("string")).otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return e.select("event_id", T.is_short_number(F.col("v")).alias("short"), T.is_blank(F.col("v")).alias("blank"))


#: One reading a line, in DuckDB.
READINGS_SQL = """list_sort(list_distinct(list_filter([
 CASE WHEN regexp_full_match(r, '\\d+') THEN r END,
 CASE WHEN regexp_full_match(r, '(\\d+|\\d{1,3}(\\.\\d{3})+),\\d+') THEN replace(replace(r, '.', ''), ',', '.') END,
 CASE WHEN regexp_full_match(r, '\\d{1,3}(\\.\\d{3})+') THEN replace(r, '.', '') END,
 CASE WHEN regexp_full_match(r, '(\\d+|\\d{1,3}(,\\d{3})+)\\.\\d+') THEN replace(r, ',', '') END,
 CASE WHEN regexp_full_match(r, '\\d{1,3}(,\\d{3})+') THEN replace(r, ',', '') END], lambda x: x IS NOT NULL)))"""
PLAIN_SQL = "list_sort(list_distinct(list_transform({}, lambda x: CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(regexp_replace(x, '^0+([0-9])', '\\1'), '0+$', ''), '\\.$', '') ELSE regexp_replace(x, '^0+([0-9])', '\\1') END)))"


@query("WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\d[\\d.,]*\\d|\\d')) AS r FROM documents) SELECT doc_id, r AS run, array_to_string(" + PLAIN_SQL.format(READINGS_SQL) + ", '|') AS readings, count(*) AS n FROM runs GROUP BY ALL")
def number_readings(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(V.number_runs(F.col("text"))).alias("run"))
    return runs.groupBy("doc_id", "run").agg(F.count("*").alias("n")).select("doc_id", "run", F.array_join(V.number_readings(F.col("run")), "|").alias("readings"), "n")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS a, array_to_string(list_sort(list_distinct([year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)] || CASE WHEN day(o_orderdate) <= 12 THEN [year(o_orderdate) * 10000 + day(o_orderdate) * 100 + month(o_orderdate)] ELSE [] END)), '|') AS a_dates, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::VARCHAR AS iso_date, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::VARCHAR AS named_date FROM orders")
def date_readings(spark, sf_dir):
    d = F.col("o_orderdate")
    join = lambda c: F.array_join(V.date_readings(c).cast("array<string>"), "|")
    a = F.date_format(d, "dd.MM.yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), join(a).alias("a_dates"), join(F.date_format(d, "yyyy-MM-dd")).alias("iso_date"), join(F.concat(F.lit("on "), F.date_format(d, "MMMM d, yyyy"))).alias("named_date"))


@query("""WITH p AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 12, '4') AS body, (p_partkey % 10)::VARCHAR AS c FROM part), q AS (SELECT p_partkey, body || c AS ean, list_sum(list_transform(range(1, 13), lambda i: substr(body, i, 1)::INT * CASE WHEN (13 - i) % 2 = 1 THEN 3 ELSE 1 END)) AS total, c FROM p)
SELECT p_partkey, ean, (10 - total % 10) % 10 = c::INT AS ok FROM q""")
def ean_check(spark, sf_dir):
    ean = F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, "4"), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", ean.alias("ean"), V.ean_valid(ean).alias("ok"))


@query("SELECT c_custkey, 'DE' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 18, '3') AS iban, ((lpad(c_custkey::VARCHAR, 18, '3') || '1314' || lpad((c_custkey % 100)::VARCHAR, 2, '0'))::HUGEINT % 97) = 1 AS ok FROM customer")
def iban_check(spark, sf_dir):
    iban = F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 18, "3"))
    return table(spark, sf_dir, "customer").select("c_custkey", iban.alias("iban"), V.iban_valid(iban).alias("ok"))


@query("WITH s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'SK' || lpad((s_suppkey * 11)::VARCHAR, 10, '0') WHEN 1 THEN 'PL' || lpad(s_suppkey::VARCHAR, 10, '5') ELSE 'FR' || s_suppkey::VARCHAR END AS vat FROM supplier) SELECT s_suppkey, vat, CASE substr(vat, 1, 2) WHEN 'SK' THEN substr(vat, 3)::BIGINT % 11 = 0 WHEN 'PL' THEN list_sum(list_transform(range(1, 10), lambda i: substr(vat, i + 2, 1)::INT * [6, 5, 7, 2, 3, 4, 5, 6, 7][i])) % 11 = substr(vat, 12, 1)::INT ELSE regexp_full_match(vat, 'FR[A-Z0-9]{2}\\d{9}') END AS ok FROM s")
def vat_check(spark, sf_dir):
    k = F.col("s_suppkey")
    vat = F.when(k % 3 == 0, F.concat(F.lit("SK"), F.lpad((k * 11).cast("string"), 10, "0"))).when(k % 3 == 1, F.concat(F.lit("PL"), F.lpad(k.cast("string"), 10, "5"))).otherwise(F.concat(F.lit("FR"), k.cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", vat.alias("vat"), V.vat_valid(vat).alias("ok"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (abs(round(l_quantity * p_retailprice, 2) - l_quantity * p_retailprice) <= 0.011 * greatest(1.0, abs(round(l_quantity * p_retailprice, 2)) / 100)) AS n_product, count(*) FILTER (abs(l_extendedprice - l_quantity * p_retailprice) <= 0.011 * greatest(1.0, abs(l_extendedprice) / 100)) AS n_printed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def arithmetic_product(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    both = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    amount = F.round(F.col("l_quantity") * F.col("p_retailprice"), 2)
    ok = lambda t: F.count_if(V.product_holds(t, F.col("l_quantity"), F.col("p_retailprice")))
    return both.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), ok(amount).alias("n_product"), ok(F.col("l_extendedprice")).alias("n_printed"))


@query("SELECT o_orderkey, abs(o_totalprice - (round(o_totalprice * 0.8, 2) + round(o_totalprice * 0.2, 2))) <= 0.011 AS sums, abs(o_totalprice - (round(o_totalprice * 0.8, 2) + 1)) <= 0.011 AS wrong FROM orders")
def arithmetic_sum(spark, sf_dir):
    t = F.col("o_totalprice")
    part = F.round(t * 0.8, 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", V.sum_holds(t, F.array(part, F.round(t * 0.2, 2))).alias("sums"), V.sum_holds(t, F.array(part, F.lit(1.0))).alias("wrong"))


@query("SELECT o_orderkey, abs(round(o_totalprice * 0.21, 2) - round(o_totalprice * 21 / 100, 2)) <= 0.011 AS ok, abs(round(o_totalprice * 0.21, 2) + 5 - round(o_totalprice * 21 / 100, 2)) <= 0.011 AS wrong FROM orders")
def arithmetic_percent(spark, sf_dir):
    t = F.col("o_totalprice")
    tax = F.round(t * 0.21, 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", V.percent_holds(tax, t, F.lit(21.0)).alias("ok"), V.percent_holds(tax + 5, t, F.lit(21.0)).alias("wrong"))


def line_boxes(spark, sf_dir) -> DataFrame:
    r = line_rows(spark, sf_dir)
    return r.select("doc_id", "row_ord", G.box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom")).alias("bbox"))


@query(f"WITH {ROWS_SQL} SELECT a.doc_id, a.row_ord::BIGINT AS row_ord, round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 10.0 / ((a.x1 - a.x0) * 10.0 + (b.x1 - b.x0) * 10.0 - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 10.0), 6) AS iou FROM rows a JOIN rows b ON a.doc_id = b.doc_id AND b.row_ord = a.row_ord + 1")
def bbox_iou_pairs(spark, sf_dir):
    """Next lines laid over each other: how much of their union they share."""
    b = line_boxes(spark, sf_dir)
    shift = lambda x, y: G.box(F.col(f"{x}.x0"), F.col(f"{y}.y0"), F.col(f"{x}.x1"), F.col(f"{y}.y1"))
    both = b.join(b.select("doc_id", (F.col("row_ord") - 1).alias("row_ord"), F.col("bbox").alias("below")), ["doc_id", "row_ord"])
    return both.select("doc_id", F.col("row_ord").cast("long").alias("row_ord"), F.round(G.iou(F.col("bbox"), shift("below", "bbox")), 6).alias("iou"))


@query("SELECT l_orderkey AS doc_id, max(l_quantity) AS total, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey")
def nms_top(spark, sf_dir):
    """Candidates at a place a line number: of those at one place the best is left."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("field_ord"), F.lit(0).alias("page"), F.col("l_linenumber").alias("row_ord"), F.xxhash64("l_partkey", "l_suppkey", "l_extendedprice").alias("start"), F.col("l_quantity").alias("total"))
    line = line.withColumn("bbox", G.box(F.lit(0.0), F.col("row_ord") * 0.02, F.lit(1.0), F.col("row_ord") * 0.02 + 0.01))
    return M.distinct_boxes(line).groupBy("doc_id").agg(F.max("total").alias("total"), F.count("*").alias("n"))


@query(f"WITH {ROWS_SQL}, p AS (SELECT a.doc_id, a.row_ord, b.row_ord AS above, a.top - b.bottom AS gap FROM rows a JOIN rows b ON a.doc_id = b.doc_id AND b.row_ord <> a.row_ord AND a.top - b.bottom BETWEEN -3.0 AND 22.0 AND least(a.x1, b.x1) > greatest(a.x0, b.x0)) SELECT r.doc_id, r.row_ord::BIGINT AS row_ord, arg_min(p.above, p.gap)::BIGINT AS above FROM rows r LEFT JOIN p ON p.doc_id = r.doc_id AND p.row_ord = r.row_ord GROUP BY ALL")
def nearest_row_above(spark, sf_dir):
    r = R.row_above(line_rows(spark, sf_dir))
    return r.select("doc_id", F.col("row_ord").cast("long").alias("row_ord"), F.col("above").cast("long").alias("above"))


@query("WITH p AS (SELECT user_id AS doc_id, dense_rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, event_id, event_type = 'purchase' AS own FROM events) SELECT doc_id, page::BIGINT AS page, last_value(CASE WHEN own THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page)::BIGINT AS header_page FROM p")
def header_band_asof(spark, sf_dir):
    """Events as pages; a purchase is a page with a header of its own."""
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("page"), "event_type")
    bands = p.where("event_type = 'purchase'").select("doc_id", "page", F.lit(0).alias("row_ord"))
    return TB.header_asof(p, bands).select("doc_id", "page", "header_page")


@query("SELECT o_custkey AS doc_id, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey, o_orderdate) AS r FROM orders) WHERE r <= 5")
def candidate_topk(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey", "o_orderdate")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 5").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_totalprice")


@query("WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS y, l_quantity AS total FROM lineitem), b AS (SELECT doc_id, max(total) AS best FROM c GROUP BY doc_id) SELECT doc_id, min(y)::BIGINT AS y, count(*) AS n FROM c JOIN b USING (doc_id) WHERE best - total < 0.05 GROUP BY doc_id")
def reading_order_tiebreak(spark, sf_dir):
    """Of the best candidates of a document the topmost."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("y"), F.col("l_quantity").alias("total"))
    best = F.max("total").over(Window.partitionBy("doc_id"))
    return c.withColumn("best", best).where(F.col("best") - F.col("total") < M.EPSILON).groupBy("doc_id").agg(F.min("y").alias("y"), F.count("*").alias("n"))


@query("WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS y, min(l_partkey) AS part FROM lineitem GROUP BY ALL), t AS (SELECT doc_id, max(y) AS ty FROM l GROUP BY doc_id) SELECT doc_id, min(y)::BIGINT AS rank FROM l JOIN t USING (doc_id) WHERE abs(y - ty) * 0.02 <= 0.7 * 0.03 GROUP BY doc_id")
def affinity_pick_lines(spark, sf_dir):
    """Every line a tied candidate of a mark; it belongs to the total, which is on the last line."""
    at = G.box(F.lit(0.0), F.col("y") * 0.02, F.lit(1.0), F.col("y") * 0.02 + 0.03)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("y")).distinct()
    cands = lines.select("doc_id", F.lit(1).alias("field_ord"), F.col("y").alias("rank"), F.lit(0).alias("page"), at.alias("bbox"), F.lit(1.0).alias("total"))
    results = lines.groupBy("doc_id").agg(F.max("y").alias("y")).select("doc_id", F.lit("total").alias("name"), F.lit(0).alias("page"), at.alias("bbox"))
    want = results.select("doc_id", F.lit(1).alias("field_ord"), F.lit("total").alias("target"))
    return affinity_pick(cands, results, want).select("doc_id", "rank")


@query("WITH f AS (SELECT DISTINCT o_custkey AS doc_id, o_orderkey AS field_ord, (o_orderkey // 2) % 40 AS slot, o_orderstatus AS v FROM orders) SELECT a.doc_id, a.field_ord AS a, b.field_ord AS b, a.v = b.v AS same_value FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.slot = b.slot AND a.field_ord < b.field_ord")
def shared_box_pairs(spark, sf_dir):
    """Orders of a customer as fields pinned to forty places."""
    y = F.floor(F.col("o_orderkey") / 2) % 40 * 0.024
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("field_ord"), F.col("o_orderstatus").alias("value"), F.lit(0).alias("page"), G.box(F.lit(0.1), y, F.lit(0.5), y + 0.02).alias("bbox")).distinct()
    return shared_boxes(f)


@query(f"WITH {LINES_SQL}, b AS (SELECT DISTINCT item_id, substr(c, i, 3) AS g FROM (SELECT item_id, {CANON.format('text')} AS c FROM benchmark), unnest(range(1, length(c) - 1)) AS u(i)), r AS (SELECT DISTINCT doc_id, line_no, substr(c, i, 3) AS g FROM (SELECT doc_id, line_no, {CANON.format('text')} AS c FROM lines), unnest(range(1, length(c) - 1)) AS u(i)) SELECT item_id, doc_id, line_no::BIGINT AS row_ord, count(*) AS shared FROM b JOIN r USING (g) GROUP BY ALL UNION ALL SELECT item_id, doc_id, line_no, 0 FROM benchmark, lines WHERE item_id NOT IN (SELECT item_id FROM b)")
def gram_prefilter(spark, sf_dir):
    """All items and all lines that share a gram; items without one go with every line."""
    rows = L.lines_of(table(spark, sf_dir, "documents")).withColumnRenamed("line_no", "row_ord")
    return M.gram_candidates(table(spark, sf_dir, "benchmark"), rows).select("item_id", "doc_id", F.col("row_ord").cast("long").alias("row_ord"), "shared")


@query(f"SELECT c.conv_id, c.turn, coalesce({CANON.format('c.text')} <> '' AND contains({CANON.format('d.text')}, {CANON.format('c.text')}), false) AS found FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id")
def quote_semijoin(spark, sf_dir):
    """Turns as quotes of the document with the conversation's number."""
    quotes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("quote"))
    rows = L.lines_of(table(spark, sf_dir, "documents")).withColumnRenamed("line_no", "row_ord")
    return C.quote_found(quotes, rows).select(F.col("doc_id").alias("conv_id"), "turn", "found")


@query(f"SELECT quality, count(DISTINCT source) AS n_models, count(DISTINCT lang) AS n_values, count(DISTINCT lang) <= 1 AS all_agree FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def agreement_across_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return C.agreement(d.select("quality", F.col("source").alias("model"), F.col("lang").alias("value")), "quality")


@query("WITH p AS (SELECT o_orderpriority AS model, o_orderkey AS field, (o_orderkey % 10) / 20.0 AS d, min(o_totalprice) AS price FROM orders GROUP BY ALL), i AS (SELECT model, price, (0.5 - d) / (0.5 + d) AS iou FROM p) SELECT model, count(*) AS n, round(avg(iou), 6) AS mean_iou, round(count(*) FILTER (iou >= 0.5) / count(*), 6) AS hit_rate FROM i GROUP BY model")
def arena_scores(spark, sf_dir):
    """Pins and a model's boxes that lie apart by up to nine tenths of their width."""
    d = F.col("field") % 10 / 20.0
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("field")).distinct()
    pins = p.select("model", "field", G.box(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.1)).alias("bbox"), F.lit(0.001).alias("cost"))
    own = p.select("model", "field", G.box(d, F.lit(0.0), d + 0.5, F.lit(0.1)).alias("bbox"))
    return C.arena_scores(pins, own).drop("cost")


@query("SELECT CASE WHEN toxic = 1 THEN 'read' WHEN quality = 1 THEN 'missed' ELSE 'invented' END AS verdict, count(*) AS n FROM labels GROUP BY 1")
def diagnostic_verdicts(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "verified").otherwise("not_found").alias("status"), (F.col("quality") == 1).alias("on_page"))
    return C.verdicts(r).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha, count(*) AS n FROM documents GROUP BY sha256(text)")
def sha_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def order_cells(spark, sf_dir):
    """Orders as printed tables: a row a line item, and the items as asserted cells."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    l = table(spark, sf_dir, "lineitem").withColumn("item", F.row_number().over(w) - 1)  # noqa: E741
    l = l.select(F.col("l_orderkey").alias("doc_id"), "item", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"), F.col("l_quantity").cast("int").cast("string").alias("qty"), F.col("l_extendedprice").cast("decimal(14,2)").cast("string").alias("amount"))
    rows = l.select("doc_id", F.lit(0).alias("page"), F.col("item").alias("row_ord"), F.concat_ws("  ", "description", "qty", "amount").alias("text"))
    cells = l.select("doc_id", "item", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(t).alias("ftype"), F.col(c).alias("value")) for c, t in (("description", "text"), ("qty", "number"), ("amount", "number"))])).alias("c")).select("doc_id", "item", "c.*")
    return cells, rows


@query("SELECT l_orderkey AS doc_id, count(*) AS n_items, count(*) AS n_in_order FROM lineitem GROUP BY l_orderkey")
def table_assignment(spark, sf_dir):
    """Every item finds its own row, since rows are printed in the items' order."""
    cells, rows = order_cells(spark, sf_dir)
    a = TB.assign_rows(TB.pair_hits(cells, rows))
    return a.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("item") == F.col("row_ord")).alias("n_in_order"))


@query("SELECT 'verified' AS status, 3 * count(*) AS n FROM lineitem")
def table_cells(spark, sf_dir):
    cells, rows = order_cells(spark, sf_dir)
    return C.status_counts(TB.align_cells(cells, rows))


def order_documents(spark, sf_dir) -> DataFrame:
    """Orders printed as small documents: doc_id, text, and the prints of their fields."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("doc_id")).agg(F.min("o_custkey").alias("c"), F.min("o_totalprice").cast("decimal(14,2)").alias("t"), F.min("o_orderdate").alias("d"))
    o = o.withColumn("net", F.round(F.col("t") * F.lit(0.8).cast("decimal(2,1)"), 2).cast("decimal(14,2)")).withColumn("vat", (F.col("t") - F.col("net")).cast("decimal(14,2)"))
    spaced = F.translate(F.format_number("t", 2), ",.", " ,")
    later = F.date_add("d", 40)
    o = o.select(
        "doc_id", "d", F.concat(F.lit("INV-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("number"), F.date_format("d", "dd.MM.yyyy").alias("date"), F.concat(F.lit("Customer Holding "), F.col("c").cast("string")).alias("customer"),
        F.col("net").cast("string").alias("net"), F.col("vat").cast("string").alias("vat"), F.col("t").cast("string").alias("total"), spaced.alias("spaced"), later.alias("later"), F.date_format(later, "dd.MM.yyyy").alias("sent"), F.date_format(later, "d MMMM yyyy").alias("came"),
    )
    lines = ["Invoice ", "number"], ["Date: ", "date"], ["", "customer"], ["Netto ", "net"], ["DPH ", "vat"], ["Total ", "spaced"], ["sent ", "sent"], ["came ", "came"]
    text = F.concat_ws("\n", *[F.concat(F.lit(a), F.col(c)) for a, c in lines], F.lit("7 boxes"))
    return o.withColumn("text", text)


@query("""WITH o AS (SELECT o_orderkey AS doc_id, min(o_custkey) AS c, min(o_totalprice)::DECIMAL(14,2) AS t, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1),
p AS (SELECT *, round(t * 0.8::DECIMAL(2,1), 2)::DECIMAL(14,2) AS net FROM o), f AS (
SELECT doc_id, 'invoice_number' AS name, 'verified' AS status, 1.0 AS confidence, 'INV-' || lpad(doc_id::VARCHAR, 8, '0') AS evidence, NULL AS proof FROM p
UNION ALL SELECT doc_id, 'invoice_date', 'verified', 1.0, strftime(d, '%d.%m.%Y'), NULL FROM p
UNION ALL SELECT doc_id, 'customer_name', 'verified', 1.0, 'Customer Holding ' || c, NULL FROM p
UNION ALL SELECT doc_id, 'subtotal', 'verified', 1.0, net::VARCHAR, 'arithmetic' FROM p
UNION ALL SELECT doc_id, 'vat_amount', 'verified', 1.0, (t - net)::DECIMAL(14,2)::VARCHAR, 'arithmetic' FROM p
UNION ALL SELECT doc_id, 'total', 'verified', 1.0, replace(replace(format('{:,.2f}', t::DOUBLE), ',', ' '), '.', ','), 'arithmetic' FROM p
UNION ALL SELECT doc_id, 'shipped', 'ambiguous', 0.8, strftime(d + INTERVAL 40 DAY, '%d.%m.%Y'), NULL FROM p
UNION ALL SELECT doc_id, 'pieces', 'low_confidence', 0.6, CASE WHEN t > 1000 AND t % 1000 = 7 THEN '007,00' ELSE '7' END, NULL FROM p
UNION ALL SELECT doc_id, 'iban', 'not_present', 1.0, NULL, NULL FROM p
UNION ALL SELECT doc_id, 'contract_number', 'not_found', 0.0, NULL, NULL FROM p)
SELECT doc_id, name, status, confidence::DOUBLE AS confidence, evidence, proof FROM f""")
def ground_orders(spark, sf_dir):
    """The whole grounding: ten asserted fields of each printed order; one is printed twice in different words, one invented, one empty, one a bare digit."""
    o = order_documents(spark, sf_dir)
    asked = {"invoice_number": F.col("number"), "invoice_date": F.date_format("d", "yyyy-MM-dd"), "customer_name": F.col("customer"), "subtotal": F.col("net"), "vat_amount": F.col("vat"), "total": F.col("total"), "shipped": F.date_format("later", "yyyy-MM-dd"), "pieces": F.lit("7"), "iban": F.lit(None).cast("string"), "contract_number": F.lit("ZZQX-7781-QQ")}
    pairs = F.array(*[F.struct(F.lit(k).alias("field_ord"), F.lit(n).alias("name"), v.alias("value")) for k, (n, v) in enumerate(asked.items())])
    specs = S.preset(spark, "invoice").unionByName(spark.sql("SELECT 'pieces' name, 'number' ftype"))
    r = ground(o.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*"), L.segments_of(o), specs, year=F.lit(1996))
    return r.select("doc_id", "name", "status", F.round("confidence", 6).alias("confidence"), "evidence", "proof")


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 5 AND length(regexp_replace(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:400], ''), '[^\\p{L}\\p{N}]', '', 'g')) >= 0.3 * length(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:400], '')) AS sane FROM documents")
def route_sanity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.layer_is_sane(F.col("text")).alias("sane"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def salvage_json(spark, sf_dir):
    """Answers with prose around the object."""
    body = T.salvage_json(F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n``` done")))
    m = F.from_json(body, "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(m, F.get(F.json_object_keys(body), F.lit(0))).alias("first_value"))


@query("SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS text_md5 FROM pages")
def html_segments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(L.html_text(F.col("html"))).alias("text_md5"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'number' WHEN o_orderkey % 4 = 1 THEN 'id' WHEN o_orderkey % 4 = 2 THEN 'date' ELSE 'percent' END AS ftype, CASE WHEN o_orderkey % 4 = 1 THEN 'iban' END AS checksum FROM orders")
def spec_inference(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "total_amount").when(k == 1, "iban").when(k == 2, "issued").otherwise("vat_rate")
    value = F.when(k == 0, F.col("o_totalprice").cast("decimal(14,2)").cast("string")).when(k == 1, F.lit("DE12X")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("21 %"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.infer_type(name, value, F.lit("string")).alias("ftype"), S.checksum_of(name).alias("checksum"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('•', length(c_name)) ELSE substr(c_name, 1, 4) || '…' || substr(c_name, length(c_name) - 3) END AS masked FROM customer")
def mask_secret(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.mask_secret(F.col("c_name")).alias("masked"))


@query("SELECT o_orderstatus AS model, sum((((o_orderkey % 1000) * 3 + (o_custkey % 500) * 15 + 5) // 10) / 1e5) AS usd FROM orders GROUP BY 1")
def estimate_usd(spark, sf_dir):
    price = F.struct(F.lit(3.0).alias("usd_in"), F.lit(15.0).alias("usd_out"))
    usd = V.estimate_usd(price, F.col("o_orderkey") % 1000, F.col("o_custkey") % 500)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.sum(usd).alias("usd"))


@query("SELECT o_orderkey, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders) GROUP BY ALL UNION ALL SELECT o_orderkey, -2 FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def alias_prints(spark, sf_dir):
    """Fields of a status; the status F has two other prints."""
    f = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("value")).distinct()
    f = f.withColumn("aliases", F.create_map(F.lit("F"), F.array(F.lit("fin"), F.lit("✓"))))
    a = with_aliases(f)
    return a.groupBy("o_orderkey", "alias").agg(F.count("*").alias("k")).select("o_orderkey", F.when(F.col("alias"), -F.col("k")).otherwise(F.col("k")).alias("n"))


@query("SELECT source, lang, count(*) AS n, grouping(source, lang) AS level FROM documents GROUP BY ROLLUP (source, lang)")
def status_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query()
def similar_names(spark, sf_dir):
    """Similarity of each part's name to the next part's."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return both.select("p_partkey", F.round(T.seq_ratio("p_name", "other"), 6).alias("ratio"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    """Events through a stream to a table and back."""
    from ..streaming.ingest import drain
    from .store import shared_path

    to = shared_path(spark, "stream")
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    drain(spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_dir(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parquet"), f"{to}/out", f"{to}/state")
    return spark.read.parquet(f"{to}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
