"""Line items assigned to printed rows, one to one and in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canon, let
from ..functions.values import number_readings, number_runs, value_numbers
from .grouped import by_group


def header_bands(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The header of each page: doc_id, page, row_ord, n_labels; the row with the most distinct labels (two at least), of equals the topmost."""
    hits = rows.crossJoin(F.broadcast(labels.select(F.collect_set(canon(F.col("label"))).alias("labels"))))
    n = let(canon(F.col("text")), lambda hay: F.size(F.filter("labels", lambda a: (a != "") & F.contains(hay, a))))
    best = hits.withColumn("n_labels", n).where("n_labels >= 2").groupBy("doc_id", "page").agg(F.max(F.struct("n_labels", (-F.col("top")).alias("up"), (-F.col("row_ord")).alias("ord"))).alias("b"))
    return best.select("doc_id", "page", (-F.col("b.ord")).alias("row_ord"), "b.n_labels")


def header_asof(pages: DataFrame, bands: DataFrame) -> DataFrame:
    """Each page with its own header or the nearest before: doc_id, page, header_page, header_row."""
    w = Window.partitionBy("doc_id").orderBy("page")
    own = pages.select("doc_id", "page").join(bands.select("doc_id", "page", F.struct("page", "row_ord").alias("h")), ["doc_id", "page"], "left")
    return own.withColumn("h", F.last("h", ignorenulls=True).over(w)).select("doc_id", "page", F.col("h.page").alias("header_page"), F.col("h.row_ord").alias("header_row"))


def _readable(rows: DataFrame) -> DataFrame:
    """doc_id, row_ord, and what cells are looked for in: hay (canonical text) and readings (of its numbers)."""
    readings = F.array_distinct(F.flatten(F.transform(number_runs(F.col("text")), number_readings)))
    return rows.where("row_ord is not null").select("doc_id", "row_ord", canon(F.col("text")).alias("hay"), readings.alias("readings"))


def _packed(cells: DataFrame, *more: str) -> DataFrame:
    """A row an item: doc_id, item, cells; a cell has its needle and, if it is a number, its numbers without sign."""
    number = F.coalesce(F.col("ftype").isin("number", "percent"), F.lit(False))
    numbers = F.when(number, F.transform(value_numbers(F.col("value")), lambda x: F.regexp_replace(x, "^-", "")))
    cell = F.struct(*more, number.alias("number"), canon(F.col("value")).alias("needle"), numbers.alias("numbers"))
    return cells.groupBy("doc_id", "item").agg(F.collect_list(cell).alias("cells"))


def _prints(cell: Column, hay: Column, readings: Column) -> Column:
    """Whether a row prints a cell: a number by any reading, another by its canonical text."""
    return F.when(cell["number"], F.arrays_overlap(cell["numbers"], readings)).otherwise((cell["needle"] != "") & F.contains(hay, cell["needle"]))


def pair_hits(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, item, row_ord, n_cells, longest): how many cells of an item a row prints, and the length of the longest.

    cells: doc_id, item, col, ftype, value. Items and rows of a document meet by a shared 3-gram of any cell; items all
    of whose cells are shorter meet every row of their document. A number cell counts by its readings, another by its
    canonical text. An item with its cells is one row and documents are the only key, so nothing but items and rows is
    shuffled; a document's pairs are looked at one by one and only those with a hit are kept.
    """
    both = _packed(cells.where("item is not null")).join(_readable(rows).hint("merge"), "doc_id")
    both = both.withColumn("hits", F.filter("cells", lambda c: _prints(c, F.col("hay"), F.col("readings")))).where(F.size("hits") > 0)
    needle_in = lambda c: (F.length(c["needle"]) >= 3) & F.contains("hay", c["needle"])
    gram_in = lambda c: F.exists(F.sequence(F.lit(1), F.length(c["needle"]) - 2), lambda k: F.contains("hay", F.substr(c["needle"], k, F.lit(3))))
    bare = ~F.exists("cells", lambda c: F.coalesce(F.length(c["needle"]) >= 3, F.lit(False)))
    # a needle that the row holds shares its grams, so these are seldom asked
    met = F.exists("hits", needle_in) | bare | F.exists(F.filter("cells", lambda c: F.length(c["needle"]) >= 3), gram_in)
    longest = F.array_max(F.transform("hits", lambda c: F.length(c["needle"])))
    each = both.select("doc_id", "item", "row_ord", F.size("hits").cast("long").alias("n"), longest.alias("long"), F.coalesce(met, F.lit(False)).alias("met"))
    return each.groupBy("doc_id", "item", "row_ord").agg(F.sum("n").alias("n_cells"), F.max("long").alias("longest"), F.bool_or("met").alias("met")).where(F.col("met") & ((F.col("n_cells") >= 2) | (F.col("longest") >= 3))).drop("met")


def assign_rows(hits: DataFrame) -> DataFrame:
    """Items to rows, one to one, in the order of both, with the most cells: doc_id, item, row_ord.

    Where each item's best row (the first of equals) lies below the item's before, these are the answer, found by
    windows. For other tables a dynamic programme over the table decides, which leaves the later row out in a tie;
    items that the order leaves without a row then take the best row that is still free. Documents are dealt once, and
    both ways read the same shuffle.
    """
    doc = Window.partitionBy("doc_id")
    seen = hits.select("doc_id", "item", "row_ord", "n_cells").repartition("doc_id")
    seen = seen.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "item").orderBy(F.desc("n_cells"), "row_ord")))
    pick = F.when(F.col("nth") == 1, F.col("row_ord"))
    seen = seen.withColumn("before", F.last(pick, ignorenulls=True).over(doc.orderBy("item", "nth").rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("torn", F.max((F.col("nth") == 1) & F.coalesce(F.col("before") >= F.col("row_ord"), F.lit(False))).over(doc))
    marked = seen.where("torn").select("doc_id", "item", "row_ord", "n_cells")
    easy = seen.where("not torn and nth = 1").select("doc_id", "item", "row_ord")

    def solve(t: list) -> list[tuple]:
        items, rows = np.unique([h.item for h in t]), np.unique([h.row_ord for h in t])
        worth = np.zeros((len(items), len(rows)))
        worth[np.searchsorted(items, [h.item for h in t]), np.searchsorted(rows, [h.row_ord for h in t])] = [h.n_cells for h in t]
        most = np.zeros((len(items) + 1, len(rows) + 1))
        for i in range(len(items)):
            take = np.where(worth[i] > 0, most[i, :-1] + worth[i], 0.0)
            most[i + 1, 1:] = np.maximum.accumulate(np.maximum(take, most[i, 1:]))
        pairs, i, j = {}, len(items), len(rows)
        while i and j:
            if most[i, j] == most[i, j - 1]:
                j -= 1
            elif most[i, j] == most[i - 1, j]:
                i -= 1
            else:
                pairs[i - 1] = j - 1
                i, j = i - 1, j - 1
        free = set(range(len(rows))) - set(pairs.values())
        for i in range(len(items)):
            if i not in pairs and (open_ := [j for j in free if worth[i, j] > 0]):
                pairs[i] = max(open_, key=lambda j: (worth[i, j], -j))
                free.discard(pairs[i])
        return [(t[0].doc_id, int(items[i]), int(rows[pairs[i]])) for i in sorted(pairs)]

    return easy.unionByName(by_group(marked, ["doc_id"], ["item", "row_ord"], solve, "doc_id long, item int, row_ord int"))


def territories(assigned: DataFrame, reach: int = 2) -> DataFrame:
    """Rows where the missing cells of an item may stand: doc_id, item, low, high, row_ord; between its neighbours' rows, `reach` rows at the ends."""
    w = Window.partitionBy("doc_id").orderBy("row_ord")
    low, high = F.lag("row_ord").over(w), F.lead("row_ord").over(w)
    return assigned.select("doc_id", "item", F.coalesce(low + 1, F.greatest(F.col("row_ord") - reach, F.lit(0))).alias("low"), F.coalesce(high - 1, F.col("row_ord") + reach).alias("high"), "row_ord")


def align_cells(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a cell: doc_id, item, col, value, status, row_ord. A cell is looked for in its item's row, then in the item's territory.

    An item's territory is looked up in its document's map of them, so that items and rows stay where they are.
    """
    zones = territories(assign_rows(pair_hits(cells, rows))).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("item", F.struct("low", "high", F.col("row_ord").alias("home")).alias("zone")))).alias("zones"))
    mine = _packed(cells, "col", "value").join(zones.hint("merge"), "doc_id", "left").withColumn("zone", F.try_element_at("zones", F.col("item"))).drop("zones")
    home, text = F.col("row_ord") == F.col("zone.home"), _readable(rows).withColumnRenamed("doc_id", "of")
    at = mine.join(text.hint("merge"), (F.col("doc_id") == F.col("of")) & (home | F.col("row_ord").between(F.col("zone.low"), F.col("zone.high"))), "left")
    seen = at.select("doc_id", "item", "row_ord", "hay", "readings", (~home).alias("away"), F.posexplode("cells").alias("pos", "c"))
    hit = (~F.col("away") | (F.length("c.needle") >= 3)) & _prints(F.col("c"), F.col("hay"), F.col("readings"))
    best = seen.groupBy("doc_id", "item", "pos").agg(F.first(F.struct("c.col", "c.value")).alias("c"), F.min(F.when(hit, F.struct("away", "row_ord"))).alias("b"))
    value = F.col("c.value")
    status = F.when(value.isNull() | (F.trim(value) == ""), "not_present").when(F.col("b").isNull(), "not_found").when(F.col("b.away"), "low_confidence").otherwise("verified")
    return best.select("doc_id", "item", "c.col", "c.value", status.alias("status"), "b.row_ord")
