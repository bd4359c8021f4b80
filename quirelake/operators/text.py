"""Glyphs as rows: regions that take them, gaps between them, the codes of a font, pages in the order of a search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content, edit, text
from ..functions.pdf import read
from ..sources.made import Made, over

PAGE = ["doc_id", "page_no"]
#: What a broken file may raise; such a file has no glyphs.
BROKEN = (RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError, AttributeError)
#: Column of the table of glyphs: its type.
GLYPHS = {"doc_id": "long", "page_no": "int", "glyph": "long", "text": "string", "x": "double", "y": "double", "advance": "double", "size": "double", "font": "string", "code": "string", "upright": "boolean"}
#: Columns beside those, on demand: the place of the page's next glyph (null after the last).
NEXT = {"next_x": "double", "next_y": "double"}
#: Rows of glyphs that close a batch.
BATCH = 1 << 15


def page_texts(data: bytes) -> Iterator[tuple[int, text.PageText]]:
    """Pages of a file with their text; none if it cannot be read."""
    doc = read(data or b"")
    for i, page in enumerate(content.pages(doc)):
        yield i, text.interpret(doc, page, content.operations(content.content_bytes(doc, page)))


def _glyph_columns(d: int, i: int, seen: text.PageText, names: tuple[str, ...]) -> list[pa.Array]:
    n, out = int(seen.lengths.sum()), []
    for name in names:
        if name == "doc_id":
            out.append(pa.array(np.full(n, d, np.int64)))
        elif name == "page_no":
            out.append(pa.array(np.full(n, i, np.int32)))
        elif name == "glyph":
            out.append(pa.array(np.arange(n, dtype=np.int64)))
        elif name == "text":
            out.append(pa.array(seen.said(), pa.string()))
        elif name == "code":
            out.append(pa.array([c.hex() for c in seen.codes()], pa.string()))
        elif name == "font":
            out.append(pa.array([r.font for r in seen.runs], pa.string()).take(pa.array(seen.columns()["run"])))
        elif name in NEXT:
            own = seen.columns()[name.removeprefix("next_")]
            out.append(pa.array(np.append(own[1:], 0.0)[:n], mask=np.arange(n) == n - 1))
        else:
            out.append(pa.array(seen.columns()[name]))
    return out


def glyph_rows(of: DataFrame | Made, *columns: str) -> DataFrame:
    """Every glyph of every page with its place, in the columns asked for (all of GLYPHS, if none is); pages that cannot be
    measured have none."""
    names = columns or tuple(GLYPHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for d, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    own = [_glyph_columns(d, i, seen, names) for i, seen in page_texts(data.as_py()) if seen.runs]
                except BROKEN:
                    continue
                parts += own
                n += sum(len(p[0]) for p in own)
                if n >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], names=list(names))
                    parts, n = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], names=list(names))

    return over(of, ["doc_id", "content"], run, ", ".join(f"{k} {(GLYPHS | NEXT)[k]}" for k in names))


def _by_file(of: DataFrame | Made, columns: list[str], schema: str, rows_of) -> DataFrame:
    """Rows (as dictionaries) that a function makes of each file's columns; none of a broken file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 32):
                rows: list[dict] = []
                for d, *values in zip(*batch.slice(start, 32).columns, strict=True):
                    try:
                        rows += [{"doc_id": d.as_py()} | r for r in rows_of(*[v.as_py() for v in values])]
                    except BROKEN:
                        continue
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return over(of, ["doc_id", *columns], run, schema)


def texts(of: DataFrame | Made) -> DataFrame:
    """doc_id, pages (page_no, glyphs, text) of each file that can be read: how many glyphs a page has, and what they say."""

    def rows(data: bytes) -> list[dict]:
        return [{"pages": [{"page_no": i, "glyphs": int(seen.lengths.sum()), "text": seen.said_whole()} for i, seen in page_texts(data)]}]

    return _by_file(of, ["content"], "doc_id long, pages array<struct<page_no:int,glyphs:long,text:string>>", rows)


def code_rows(of: DataFrame | Made) -> DataFrame:
    """doc_id, font, text, code of the glyphs, each once a file."""

    def rows(data: bytes) -> list[dict]:
        drawn = {(r.font, r.of.text.get(c), c) for _, seen in page_texts(data) for r in seen.runs for c in set(r.parts())}
        return [{"font": f, "text": t, "code": c.hex()} for f, t, c in drawn]

    return _by_file(of, ["content"], "doc_id long, font string, text string, code string", rows)


def region_counts(of: DataFrame | Made) -> DataFrame:
    """`region_hits` of files that bring their regions along (column `regions`: ord, id, page, x, y, width, height), page by
    page, so that no glyph is a row."""

    def rows(data: bytes, regions: list[dict] | None) -> list[dict]:
        taken: dict[str, int] = {}
        wanted = sorted((r for r in regions or [] if edit.valid(r)), key=lambda r: r["ord"])
        for i, seen in page_texts(data):
            own = [r for r in wanted if r["page"] == i]
            if not own or not seen.runs:
                continue
            at = seen.columns()
            px, py, free = at["x"] + at["advance"] / 2, at["y"] + 0.3 * at["size"], at["upright"].copy()
            for r in own:
                held = free & edit.inside(r, px, py)
                taken[r["id"]] = taken.get(r["id"], 0) + int(held.sum())
                free &= ~held
        return [{"id": k, "glyphs": n} for k, n in taken.items() if n]

    return _by_file(of, ["content", "regions"], "doc_id long, id string, glyphs long", rows)


def region_hits(glyphs: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, id, glyphs: each glyph goes to the first region, by ord, that holds its probe point.

    An equi join on file and page bounds the range condition; a page holds few regions.
    """
    at = glyphs.where("upright").withColumns({"px": F.col("x") + F.col("advance") / 2, "py": F.col("y") + 0.3 * F.col("size")}).select(*PAGE, "glyph", "px", "py")
    box = regions.select("doc_id", F.col("page").alias("page_no"), "ord", "id", F.col("x").alias("rx"), F.col("y").alias("ry"), "width", "height").where(valid("rx", "ry"))
    inside = F.col("px").between(F.col("rx"), F.col("rx") + F.col("width")) & F.col("py").between(F.col("ry"), F.col("ry") + F.col("height"))
    taken = at.join(box, PAGE).where(inside).groupBy(*PAGE, "glyph").agg(F.min_by("id", "ord").alias("id"))
    return taken.groupBy("doc_id", "id").agg(F.count("*").alias("glyphs"))


def valid(x: str, y: str) -> Column:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return finite(x) & finite(y) & finite("width") & finite("height") & (F.col("width") > 0) & (F.col("height") > 0)


def annotation_overlaps(annotations: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, page_no, position, unreadable: annotations that a region of their page meets, or whose place is unknown.

    Overlap is strict, and nothing without an area overlaps.
    """
    box = regions.select("doc_id", F.col("page").alias("page_no"), F.col("x").alias("rx"), F.col("y").alias("ry"), "width", "height").where(valid("rx", "ry"))
    r = F.col("rect")
    x0, x1, y0, y1 = F.least(r[0], r[2]), F.greatest(r[0], r[2]), F.least(r[1], r[3]), F.greatest(r[1], r[3])
    meets = (x0 < x1) & (y0 < y1) & (x0 < F.col("rx") + F.col("width")) & (F.col("rx") < x1) & (y0 < F.col("ry") + F.col("height")) & (F.col("ry") < y1)
    hits = annotations.join(box, PAGE).where(r.isNull() | meets)
    return hits.select(*PAGE, "position", r.isNull().alias("unreadable")).distinct()


def code_inventory(glyphs: DataFrame) -> DataFrame:
    """doc_id, font, text, codes, ambiguous: the codes that a font draws each character with."""
    seen = glyphs.where("text IS NOT NULL").groupBy("doc_id", "font", "text").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return seen.withColumn("ambiguous", F.size("codes") > 1)


def gaps(glyphs: DataFrame) -> DataFrame:
    """Room between each glyph and the next one of its line. Rows that hold the next glyph's place need no order."""
    rows = glyphs
    if not {*NEXT} <= {*glyphs.columns}:
        order = Window.partitionBy(*PAGE).orderBy("glyph")
        rows = glyphs.withColumns({"next_x": F.lead("x").over(order), "next_y": F.lead("y").over(order)})
    return rows.where(F.abs(F.col("next_y") - F.col("y")) <= 0.01).withColumn("gap", F.col("next_x") - F.col("x") - F.col("advance"))


def scan_order(pages: DataFrame, targets: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, target, page_no, place: the target page, then its neighbours by distance, the next before the last."""
    rows = pages.select(*PAGE).join(targets, "doc_id")
    order = Window.partitionBy("doc_id", "target").orderBy(F.abs(F.col("page_no") - F.col("target")), F.col("page_no") < F.col("target"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
