"""The library's verbs over one file or a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compress as _compress
from .operators import documents as D
from .operators import editing as E
from .operators import images as I
from .options import CompressOptions, EditOptions, Region, Replacement
from .sources.tables import facts, pdf_files, section

__all__ = ["CompressOptions", "EditOptions", "Region", "Replacement", "analyze", "arrange_pages", "compress", "pdf_files", "remove_text_glyphs", "replace_text_glyphs", "structural_telemetry"]


def analyze(files: DataFrame) -> DataFrame:
    """doc_id, status, pages, bytes, is_signed, has_scanned_pages, images, and a warning for signed files."""
    from .plans.iterate import checkpoint

    found = checkpoint(facts(files, "objects", "images", "placements", "resources", "pages", "page_text"))
    images = section(found, "images")
    placed = I.placed_images(section(found, "placements"), section(found, "resources"), images)
    scans = I.scanned_pages(placed, section(found, "pages"), section(found, "page_text")).groupBy("doc_id").agg(F.bool_or("scanned").alias("has_scanned_pages"))
    marks = D.signed(found, section(found, "objects"))
    rows = found.select("doc_id", "status", "error", F.col("page_count").alias("pages"), F.col("length").alias("bytes"), F.size("images").alias("images"))
    rows = rows.join(marks, "doc_id", "left").join(scans, "doc_id", "left")
    return rows.withColumn("warnings", F.array_compact(F.array(F.when(F.col("is_signed"), F.lit("signed_document")))))


def compress(files: DataFrame, options: CompressOptions = CompressOptions()) -> DataFrame:
    return _compress.compress(files, options)


def remove_text_glyphs(files: DataFrame, regions: DataFrame, options: EditOptions = EditOptions()) -> DataFrame:
    return E.remove_text(files, regions, options)


def replace_text_glyphs(files: DataFrame, replacements: DataFrame, options: EditOptions = EditOptions()) -> DataFrame:
    return E.replace_text(files, replacements, options)


def arrange_pages(files: DataFrame, plan: DataFrame, options: EditOptions = EditOptions()) -> DataFrame:
    return E.arrange_pages(files, plan, options)


def structural_telemetry(files: DataFrame) -> DataFrame:
    """doc_id, inline images (count, bytes), and images that only forms paint, by depth."""
    from .operators.telemetry import telemetry

    return telemetry(files)


def one_file(spark: SparkSession, data: bytes) -> DataFrame:
    """A table of one file, doc_id 0."""
    return spark.createDataFrame([(0, "", len(data), bytearray(data))], "doc_id long, path string, length long, content binary")


def region_rows(spark: SparkSession, regions: list[Region], doc_id: int = 0) -> DataFrame:
    rows = [(doc_id, i, r.id, r.page, float(r.x), float(r.y), float(r.width), float(r.height)) for i, r in enumerate(regions)]
    return spark.createDataFrame(rows, "doc_id long, ord int, id string, page int, x double, y double, width double, height double")
