"""Command line: compress, analyze, remove-text and arrange over one file or a folder.

Exit: 0 clean, 1 error, 2 written without a guarantee, 3 the report could not be shown.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from pyspark.sql import SparkSession


from . import api
from .functions.text import parse_region
from .operators import compress as C
from .operators import editing as E
from .options import POLICIES, PROFILES, CompressOptions, Region


def written(path: str, data: bytes) -> None:
    """A temporary file in the target's folder takes its place when whole."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    os.replace(tmp, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirelake", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    c = sub.add_parser("compress")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--profile", choices=[*PROFILES], default="ebook")
    c.add_argument("--dpi", type=int)
    c.add_argument("--quality", type=int)
    c.add_argument("--grayscale", action="store_true")
    c.add_argument("--dedupe-images", action="store_true")
    c.add_argument("--signatures", choices=POLICIES, default="flatten")
    a = sub.add_parser("analyze")
    a.add_argument("input")
    r = sub.add_parser("remove-text")
    r.add_argument("input")
    r.add_argument("output")
    r.add_argument("--region", action="append", required=True, help="[id@]page:x,y,w,h, pages from 1")
    for s in (c, a, r):
        s.add_argument("--json", action="store_true")
    return p


def regions_of(texts: list[str]) -> list[Region]:
    found = [Region(*parse_region(t, i)) for i, t in enumerate(texts)]
    if len({r.id for r in found}) < len(found):
        raise ValueError("a region id is given twice")
    return found


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[int, dict]:
    with open(args.input, "rb") as f:
        files = api.one_file(spark, f.read())
    if args.verb == "analyze":
        row = api.analyze(files).first()
        return int(row["status"] != "ok"), row.asDict(True)
    if args.verb == "compress":
        options = CompressOptions(profile=args.profile, image_dpi=args.dpi, jpeg_quality=args.quality, grayscale=args.grayscale, dedupe_images=args.dedupe_images, signatures=args.signatures)
        done = api.compress(files, options)
        both = done.join(C.report_json(done, options.signatures), "doc_id").first()
        if both["status"] != "ok":
            return 1, {"error": both["error"]}
        written(args.output, bytes(both["content"]))
        return 0, json.loads(both["report"])
    row = E.exit_code(api.remove_text_glyphs(files, api.region_rows(spark, regions_of(args.region)))).first()
    if row["exit_code"] != 1:
        written(args.output, bytes(row["content"]))
    report = row.asDict(True)
    report.pop("content")
    return row["exit_code"], report


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quirelake").getOrCreate()
    try:
        code, report = run(args, spark)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    try:
        print(json.dumps(report) if args.json else "\n".join(f"{k}: {v}" for k, v in report.items()))
    except OSError:
        return 3
    return code


if __name__ == "__main__":
    sys.exit(main())
