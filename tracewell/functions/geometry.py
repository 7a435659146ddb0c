"""Boxes and affine maps, as columns. A box is a struct x0, y0, x1, y1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def normalised(b: Column, width: Column, height: Column) -> Column:
    """In shares of the page, within 0 and 1, corners in order."""
    x = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), b[k] / s)) for k, s in (("x0", width), ("y0", height), ("x1", width), ("y1", height))]
    return box(F.least(x[0], x[2]), F.least(x[1], x[3]), F.greatest(x[0], x[2]), F.greatest(x[1], x[3]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(w * h / F.greatest(F.lit(1e-12), area(a) + area(b) - w * h))


def center_in(a: Column, truth: Column, pad: float = 0.004) -> Column:
    x, y = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    return (x >= truth["x0"] - pad) & (x <= truth["x1"] + pad) & (y >= truth["y0"] - pad) & (y <= truth["y1"] + pad)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared width over the narrower width."""
    inter = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / F.greatest(F.lit(1e-9), F.least(a1 - a0, b1 - b0)))


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of an array; null if it is empty."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1))


def flipped(b: Column, height: Column) -> Column:
    """A box measured from the bottom of its page, measured from the top."""
    return box(b["x0"], height - b["y1"], b["x1"], height - b["y0"])


def affine(a, b, c, d, e, f) -> Column:
    """The map of (x, y) to (a x + b y + c, d x + e y + f)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(*[lit(v).cast("double").alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def scaled(sx: Column, sy: Column) -> Column:
    return affine(sx, 0, 0, 0, sy, 0)


def turned(k: Column, width: Column, height: Column) -> Column:
    """k counter-clockwise quarter turns of a page; odd ones change its width for its height."""
    k = F.pmod(k, F.lit(4))
    return F.when(k == 1, affine(0, 1, 0, -1, 0, width)).when(k == 2, affine(-1, 0, width, 0, -1, height)).when(k == 3, affine(0, -1, height, 1, 0, 0)).otherwise(affine(1, 0, 0, 0, 1, 0))


def uprighted(orientation: Column, width: Column, height: Column) -> Column:
    """What sets a raster upright that was stored with this EXIF orientation (1 to 8; others are upright)."""
    maps = {2: (-1, 0, width, 0, 1, 0), 3: (-1, 0, width, 0, -1, height), 4: (1, 0, 0, 0, -1, height), 5: (0, 1, 0, 1, 0, 0), 6: (0, -1, height, 1, 0, 0), 7: (0, -1, height, -1, 0, width), 8: (0, 1, 0, -1, 0, width)}
    out = affine(1, 0, 0, 0, 1, 0)
    for k, m in maps.items():
        out = F.when(orientation == k, affine(*m)).otherwise(out)
    return out


def followed(m: Column, n: Column) -> Column:
    """m, and n after it."""

    def both(s: Column) -> Column:
        m, n = s["m"], s["n"]
        row = lambda p, q, r: (n[p] * m["a"] + n[q] * m["d"], n[p] * m["b"] + n[q] * m["e"], n[p] * m["c"] + n[q] * m["f"] + n[r])
        return affine(*row("a", "b", "c"), *row("d", "e", "f"))

    return let(F.struct(m.alias("m"), n.alias("n")), both)


def chained(maps: Column) -> Column:
    """An array of maps as one, the first first."""
    return F.aggregate(maps, affine(1, 0, 0, 0, 1, 0), followed)


def inverted(m: Column) -> Column:
    """What undoes a map; null where it has no inverse."""

    def undo(s: Column) -> Column:
        m, det = s["m"], s["det"]
        back = affine(m["e"] / det, -m["b"] / det, (m["b"] * m["f"] - m["e"] * m["c"]) / det, -m["d"] / det, m["a"] / det, (m["d"] * m["c"] - m["a"] * m["f"]) / det)
        return F.when(det.isNotNull(), back)

    own = let(m, lambda m: F.struct(m.alias("m"), F.nullif(m["a"] * m["e"] - m["b"] * m["d"], F.lit(0.0)).alias("det")))
    return let(own, undo)


def moved(m: Column, x: Column, y: Column) -> Column:
    return let(m, lambda m: F.struct((m["a"] * x + m["b"] * y + m["c"]).alias("x"), (m["d"] * x + m["e"] * y + m["f"]).alias("y")))


def moved_box(m: Column, b: Column) -> Column:
    """The box around a moved box."""
    ends = let(F.struct(m.alias("m"), b.alias("b")), lambda s: F.array(*[F.struct((s["m"]["a"] * s["b"][x] + s["m"]["b"] * s["b"][y] + s["m"]["c"]).alias("x"), (s["m"]["d"] * s["b"][x] + s["m"]["e"] * s["b"][y] + s["m"]["f"]).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")]))

    def around(ps: Column) -> Column:
        side = lambda k, f: f(F.transform(ps, lambda p: p[k]))
        return box(side("x", F.array_min), side("y", F.array_min), side("x", F.array_max), side("y", F.array_max))

    return let(ends, around)


def baseline_angle(quad: Column) -> Column:
    """Angle of the lower edge of a quad, an array of four struct(x, y); null if it is shorter than 2."""
    lower = F.slice(F.array_sort(F.transform(quad, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))), 3, 2)
    ends = F.array_sort(F.transform(lower, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    return F.when((F.size(quad) == 4) & (b["x"] - a["x"] >= 2.0), F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def page_skew(angles: Column) -> Column:
    """The upper median of a page's angles, if there are three and it lies from half a degree to fifteen; else 0."""
    own = F.filter(angles, lambda a: a.isNotNull())
    straight = lambda s: (s["n"] < 3) | (F.abs(s["m"]) < math.radians(0.5)) | (F.abs(s["m"]) > math.radians(15))
    return let(F.struct(F.size(own).alias("n"), upper_median(own).alias("m")), lambda s: F.when(straight(s), F.lit(0.0)).otherwise(s["m"]))


def char_edges(text: Column) -> Column:
    """Where the characters of a text begin, and the last ends, as shares of its width by their weights."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    upto = F.aggregate(chars, F.array(F.lit(0.0)), lambda out, c: F.array_append(out, F.element_at(out, -1) + glyph_weight(c)))
    return let(upto, lambda u: F.transform(u, lambda w: w / F.greatest(F.element_at(u, -1), F.lit(1e-9))))


#: Pixels that the recogniser takes, and the least side it scales an image to.
OCR_PIXELS, OCR_SIDE = 14_000_000, 736


def ocr_pixels(width: Column, height: Column) -> Column:
    """How many pixels an image has when its shorter side is scaled up to OCR_SIDE."""
    short = F.least(width, height)
    up = F.greatest(F.lit(1.0), OCR_SIDE / F.greatest(short, F.lit(1)))
    return F.when(short <= 0, F.lit(0)).otherwise(F.floor(width * height * up * up)).cast("long")


def ocr_size(width: Column, height: Column) -> Column:
    """struct(width, height, padded): what an image is made for the recogniser: strips are padded, larger images shrunk, sides whole multiples of 32."""
    over = ocr_pixels(width, height) > OCR_PIXELS
    strip = over & (F.least(width, height) < OCR_SIDE)
    up = lambda v: F.greatest(F.ceil(v / 32) * 32, F.lit(OCR_SIDE)).cast("int")
    shrink = F.when(over, F.sqrt(OCR_PIXELS / (width.cast("double") * height))).otherwise(F.lit(1.0))
    down = lambda v: F.greatest(F.lit(32), F.floor(F.floor(v * shrink) / 32) * 32).cast("int")
    return F.struct(F.when(strip, up(width)).otherwise(down(width)).alias("width"), F.when(strip, up(height)).otherwise(down(height)).alias("height"), strip.alias("padded"))


def ctc_collapse(steps: Column) -> Column:
    """What the best symbols of each step spell: array of struct(symbol, step); blanks (0) and repeats of the step before are left out."""
    each = F.transform(steps, lambda x, i: F.struct(x.alias("symbol"), i.alias("step"), F.get(steps, i - 1).alias("before")))
    kept = F.filter(each, lambda x: (x["symbol"] != 0) & ((x["step"] == 0) | (x["symbol"] != x["before"])))
    return F.transform(kept, lambda x: F.struct(x["symbol"].alias("symbol"), x["step"].alias("step")))


def char_slices(quad: Column, shares: Column) -> Column:
    """Boxes of parts of a quad along its reading edge: from top left to top right, or down to bottom left if it is half as high again as wide.

    quad: array of four struct(x, y), clockwise from top left; shares: array of struct(start, end).
    """
    p = [F.get(quad, F.lit(k)) for k in range(4)]
    apart = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))
    wide, high = apart(p[0], p[1]), apart(p[0], p[3])
    tall = (wide > 0) & (high >= 1.5 * wide)
    along = lambda a, b, f, k: a[k] + (b[k] - a[k]) * f
    # both long edges run in reading direction: one from the first corner, the other from the corner across
    near = (p[0], F.when(tall, p[3]).otherwise(p[1]))
    far = (F.when(tall, p[1]).otherwise(p[3]), p[2])

    def part(s: Column) -> Column:
        at = lambda k: F.array(*[along(*edge, s[end], k) for edge in (near, far) for end in ("start", "end")])
        return box(F.array_min(at("x")), F.array_min(at("y")), F.array_max(at("x")), F.array_max(at("y")))

    return F.transform(shares, part)


#: Narrow and wide characters.
NARROW, WIDE = ".,:;!i|l'`ıíì()[]{} ", "mwMW@"


def glyph_weight(ch: Column) -> Column:
    """Relative width of a character."""
    return F.when(F.contains(F.lit(NARROW), ch), 0.45).when(F.contains(F.lit(WIDE), ch), 1.45).when(ch.rlike(r"^\p{Ll}$"), 0.85).otherwise(1.0)
