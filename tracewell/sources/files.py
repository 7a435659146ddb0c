"""Files as documents and pages: what can be read, by whom, and what is left out."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import layer_is_sane

#: Where a PDF's mark may stand, and the frames and pixels of an image that are read.
HEAD, MAX_FRAMES, MAX_PIXELS = 1024, 50, 400_000_000
#: How files of the kinds read begin.
IMAGE_HEADS = ("89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A", "424D", "474946383761", "474946383961", "52494646")

PAGES = "doc_id string, page int, width double, height double, route string, text string, error string"


class SourceError(ValueError):
    """A source that can't be read."""


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as documents: doc_id (digest of the bytes), source, kind (pdf, image or null), error, content.

    A path that isn't there raises FileNotFoundError, one empty file SourceError; of a folder Spark passes empty files
    over. Files of another kind are rows with an error, so that one bad file does not end a job over many. What stands
    before a PDF's mark, in its first HEAD bytes, is cut off.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(where) and store.getFileStatus(where).isFile() and not store.getFileStatus(where).getLen():
        raise SourceError(f"{path} is empty")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    at = F.instr(F.decode(F.substr("content", F.lit(1), F.lit(HEAD)), "ISO-8859-1"), "%PDF-")
    head = F.hex(F.substr("content", F.lit(1), F.lit(8)))
    image = F.lit(False)
    for x in IMAGE_HEADS:
        image = image | head.startswith(x)
    kind = F.when(at > 0, "pdf").when(image, "image")
    error = F.when(kind.isNull(), "neither PDF nor image")
    body = F.when(at > 1, F.substr("content", at)).otherwise(F.col("content"))
    return files.select(F.sha2("content", 256).alias("doc_id"), F.col("path").alias("source"), kind.alias("kind"), error.alias("error"), body.alias("content"))


def read_pages(documents: DataFrame, reader: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Pages of documents, by a reader that the caller brings: (kind, content) gives (width, height, text) for each page.

    Returns PAGES. A page without an area has size 1 by 1 and counts as text; others go by their text layer. A
    document that its reader can't open is one row with an error.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in it:
            out: list[tuple] = []
            for i, kind, content in zip(some["doc_id"], some["kind"], some["content"], strict=True):
                try:
                    out += [(i, k, float(w), float(h), None, text, None) for k, (w, h, text) in enumerate(reader(kind, bytes(content)))]
                except Exception as e:  # the reader's own errors, of any kind, are the document's
                    out.append((i, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")]).astype({"page": "Int32"})

    pages = documents.where("error is null").select("doc_id", "kind", "content").mapInPandas(run, PAGES)
    flat = (F.col("width") <= 0) | (F.col("height") <= 0)
    route = F.when(F.col("error").isNotNull(), None).when(flat | layer_is_sane(F.coalesce("text", F.lit(""))), "textlayer").otherwise("ocr")
    size = lambda c: F.when(flat, 1.0).otherwise(F.col(c))
    return pages.select("doc_id", "page", size("width").alias("width"), size("height").alias("height"), route.alias("route"), "text", "error")


def bounded_frames(frames: DataFrame) -> DataFrame:
    """frames(doc_id, frame, width, height) with kept and dropped: the first MAX_FRAMES of an image while their pixels sum up to MAX_PIXELS; dropped counts the others of the document."""
    w = Window.partitionBy("doc_id")
    before = F.sum(F.col("width").cast("long") * F.col("height").cast("long")).over(w.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    kept = (F.col("frame") < MAX_FRAMES) & (before <= MAX_PIXELS)
    return frames.withColumn("kept", kept).withColumn("dropped", F.count_if(~F.col("kept")).over(w))


def recognised(pages: DataFrame, make: Callable[[], Callable[[pd.DataFrame], Iterator[tuple]]]) -> DataFrame:
    """Segments of pages by a recogniser that the caller brings: make(), once a partition, gives a function from a page's row to (text, x0, top, x1, bottom, conf)."""
    schema = "doc_id string, page int, seg_ord long, text string, x0 double, top double, x1 double, bottom double, conf double"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make()
        for some in it:
            rows = [(p.doc_id, p.page, k, *seg) for p in some.itertuples(index=False) for k, seg in enumerate(read(p))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return pages.mapInPandas(run, schema)


RECOGNISERS: dict[str, Callable] = {}


def recogniser(name: str = "auto") -> Callable:
    """A registered recogniser by name; auto is the only one there is. An unknown name is an error even where nothing has to be recognised."""
    if name == "auto" and len(RECOGNISERS) == 1:
        return next(iter(RECOGNISERS.values()))
    if name not in RECOGNISERS:
        raise ValueError(f"no recogniser {name!r}; there are {', '.join(sorted(RECOGNISERS)) or 'none'}")
    return RECOGNISERS[name]


def words_with_chars(words: DataFrame, chars: DataFrame) -> DataFrame:
    """words(doc_id, page, word, text, x0, top, x1, bottom) with char_boxes: the boxes of the characters inside each word, within 1 point, from left to right; null where they don't spell it.

    Words and characters meet by strips of the page eight points high. They are never broadcast: a table that was
    exploded is larger than Spark's estimate.
    """
    strip = 8.0
    spread = words.withColumn("strip", F.explode(F.sequence(F.floor((F.col("top") - 1) / strip), F.floor((F.col("bottom") + 1) / strip))))
    own = chars.select("doc_id", "page", F.floor(F.col("top") / strip).alias("strip"), F.col("text").alias("ch"), F.col("x0").alias("cx0"), F.col("top").alias("ctop"), F.col("x1").alias("cx1"), F.col("bottom").alias("cbottom"))
    inside = (F.col("cx0") >= F.col("x0") - 1) & (F.col("cx1") <= F.col("x1") + 1) & (F.col("ctop") >= F.col("top") - 1) & (F.col("cbottom") <= F.col("bottom") + 1)
    met = spread.join(own.hint("merge"), ["doc_id", "page", "strip"]).where(inside)
    per = met.groupBy("doc_id", "page", "word").agg(F.array_sort(F.collect_list(F.struct("cx0", "ctop", "cx1", "cbottom", "ch"))).alias("cs"))
    boxes = F.transform("cs", lambda c: F.struct(c["cx0"].alias("x0"), c["ctop"].alias("top"), c["cx1"].alias("x1"), c["cbottom"].alias("bottom")))
    spelled = F.array_join(F.transform("cs", lambda c: c["ch"]), "") == F.col("text")
    return words.join(per.hint("merge"), ["doc_id", "page", "word"], "left").withColumn("char_boxes", F.when(spelled, boxes)).drop("cs")


def load_env(start: str | Path = ".", into: dict | None = None) -> Path | None:
    """Settings from the nearest .env file, from `start` up to the home folder; what is set already stays. Returns the file read."""
    into, here, home = os.environ if into is None else into, Path(start).resolve(), Path.home()
    for folder in (here, *here.parents):
        file = folder / ".env"
        if file.is_file():
            for line in file.read_text(encoding="utf-8").splitlines():
                key, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and key and not key.startswith("#"):
                    into.setdefault(key.strip(), value.strip().strip("'\""))
            return file
        if folder == home:
            break
    return None
