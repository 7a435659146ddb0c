"""Command line: ground a text against a JSON of values, show results, list the fields of a preset."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __doc__ as about

ERRORS = (FileNotFoundError, ValueError, OSError)


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code 1 and one line on stderr for what can't be read; results go to -o, where - is stdout."""
    p = argparse.ArgumentParser(prog="tracewell", description=(about or "").strip())
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("ground", help="locate the values of a JSON object in a text file")
    g.add_argument("text")
    g.add_argument("values")
    g.add_argument("--schema")
    for name in ("overlay", "view"):
        s = sub.add_parser(name, help="draw a result" if name == "overlay" else "a result as a page")
        s.add_argument("result")
    f = sub.add_parser("fields", help="the fields of a preset")
    f.add_argument("preset")
    sub.add_parser("version")
    for s in sub.choices.values():
        s.add_argument("-o", "--out", default="-")
        s.add_argument("-q", "--quiet", action="store_true")
    args = p.parse_args(argv)
    try:
        text, summary = run(args, spark)
    except ERRORS as e:
        print(f"tracewell: {e}", file=sys.stderr)
        return 1
    if args.out == "-":
        sys.stdout.buffer.write(text.encode("utf-8") + b"\n")
    else:
        Path(args.out).write_text(text, encoding="utf-8")
    if summary and not args.quiet:
        print(summary, file=sys.stderr)
    return 0


def run(args, spark=None) -> tuple[str, str]:
    if args.command == "version":
        return "0.2", ""
    if args.command == "fields":
        from .plans.specs import PRESETS

        if args.preset not in PRESETS:
            raise ValueError(f"no preset {args.preset!r}; there are {', '.join(PRESETS)}")
        return json.dumps(PRESETS[args.preset], indent=1), ""
    if args.command in ("overlay", "view"):
        from .sinks.pictures import overlay_svg, viewer_html

        payload = Path(args.result).read_text(encoding="utf-8")
        fields = json.loads(payload)["fields"]
        return (viewer_html(payload) if args.command == "view" else overlay_svg([{"name": n, "page": 0, "value": None} | v for n, v in fields.items()], 595, 842)), ""
    return _ground(args, spark)


def _ground(args, spark) -> tuple[str, str]:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.ground import ground
    from .plans.specs import resolve_specs
    from .sinks.payload import payloads
    from .sources.layout import assertions_of, segments_of

    values = Path(args.values).read_text(encoding="utf-8")
    if not isinstance(json.loads(values), dict):
        raise ValueError("the values are no JSON object")
    text = Path(args.text).read_text(encoding="utf-8")
    spark = spark or SparkSession.builder.getOrCreate()
    specs, proofs = resolve_specs(spark, args.schema)
    asserted = assertions_of(spark.createDataFrame([(1, values)], "doc_id long, extraction string")).withColumn("field_ord", F.row_number().over(_order()) - 1)
    results = ground(asserted.select("doc_id", "field_ord", "name", "value", "quote"), segments_of(spark.createDataFrame([(1, text)], "doc_id long, text string")), specs, proofs=proofs)
    found = payloads(results).first()
    body = found.json if found else json.dumps({"schema": 1, "fields": {}, "summary": {}})
    return body, ", ".join(f"{n} {s}" for s, n in sorted(json.loads(body)["summary"].items()))


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("field_ord", "name")


if __name__ == "__main__":
    sys.exit(main())
