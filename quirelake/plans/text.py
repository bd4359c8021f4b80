"""Registered queries about glyphs, regions and gray eligibility, each with the SQL over the rows that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grayscale as G
from ..operators import text as T
from ..sources.tables import facts, section
from .editing import FIRST_LINE, _asking, _first_lines
from .inspection import BASE, _found, files
from .iterate import checkpoint


def region_first_wins(spark, sf_dir):
    """Two regions over the first line: the first one takes what it holds, the second the rest."""
    return T.region_counts(_asking(spark, sf_dir, "regions", FIRST_LINE | {"width": 54.0}, FIRST_LINE | {"ord": 1, "id": "rest"}))


def annotation_overlaps(spark, sf_dir):
    found = facts(files(spark, sf_dir), "annotations(page_no, position, rect)")
    boxes = _first_lines(spark, sf_dir).withColumns({"x": F.lit(290.0), "y": F.lit(690.0), "width": F.lit(20.0), "height": F.lit(40.0)})
    return T.annotation_overlaps(section(found, "annotations"), boxes).groupBy("doc_id").agg(F.count("*").alias("annotations"), F.count_if("unreadable").alias("unreadable"))


def code_inventory(spark, sf_dir):
    rows = T.code_inventory(T.code_rows(files(spark, sf_dir)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("characters"), F.count_if("ambiguous").alias("ambiguous"))


def glyph_gaps(spark, sf_dir):
    rows = T.gaps(T.glyph_rows(files(spark, sf_dir), "doc_id", "x", "y", "advance", "next_x", "next_y"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.count_if(F.abs(F.col("gap")) > 0.01).alias("open"))


def page_scan_order(spark, sf_dir):
    pages = checkpoint(section(facts(files(spark, sf_dir), "pages(page_no)"), "pages"))
    targets = pages.groupBy("doc_id").agg(F.max("page_no").alias("target"))
    rows = T.scan_order(pages, targets)
    return rows.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max_by("page_no", "place").cast("long").alias("last"))


def gray_residuals(spark, sf_dir):
    found = _found(spark, sf_dir, "images(num, gen, filters, color_space, channels, hival, palette_bytes, bits, is_mask, decode, has_color_key)", "page_text(page_no, inline_color)")
    images = section(found, "images")
    none = images.select("doc_id", "num", "gen").where("false")
    rows = G.gray_summary(G.gray_plan(images, none, G.mask_groups(images, found)), section(found, "page_text"))
    return rows.agg(*[F.sum(c).alias(c) for c in ("eligible", *G.RESIDUALS)], F.count("inline_pages").alias("inline_pages"))


QUERIES = {f.__name__: f for f in (region_first_wins, annotation_overlaps, code_inventory, glyph_gaps, page_scan_order, gray_residuals)}

SQL = {
    "region_first_wins": BASE + ", h AS (SELECT d, least(n, 80) AS n FROM ok WHERE n > 0) SELECT d AS doc_id, 'line' AS id, least(n, 10) AS glyphs FROM h UNION ALL SELECT d, 'rest', n - 10 FROM h WHERE n > 10",
    "annotation_overlaps": BASE + "SELECT d AS doc_id, 1::BIGINT AS annotations, 0::BIGINT AS unreadable FROM ok WHERE pages > 1",
    "code_inventory": BASE + "SELECT d AS doc_id, CAST(len(list_distinct(string_split(t, ''))) AS BIGINT) AS characters, 0::BIGINT AS ambiguous FROM ok WHERE n > 0",
    "glyph_gaps": BASE + "SELECT d AS doc_id, n - lines AS pairs, 0::BIGINT AS open FROM ok WHERE n > lines",
    "page_scan_order": BASE + "SELECT d AS doc_id, least(8, pages) AS pages, pages - least(8, pages) AS last FROM ok",
    "gray_residuals": BASE + "SELECT count(*) FILTER (kind = 0) AS eligible, 0::BIGINT AS preserved_stamp, 0::BIGINT AS mask_group, 0::BIGINT AS decode, 0::BIGINT AS color_key_mask, count(*) FILTER (kind IN (2, 3)) AS image_unsupported, 0::BIGINT AS inline_pages FROM img",
}
