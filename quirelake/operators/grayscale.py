"""Which colour images may turn gray, and why the others may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import _KEY, unsupported_reason

#: Residual reasons in the order in which they apply.
RESIDUALS = ("preserved_stamp", "mask_group", "decode", "color_key_mask", "image_unsupported")


def identity_decode(decode: Column) -> Column:
    """No /Decode, or the one that changes nothing."""
    return decode.isNull() | F.forall(F.transform(decode, lambda v, i: v == i % 2), lambda ok: ok)


def mask_groups(images: DataFrame, found: DataFrame) -> DataFrame:
    """Keys of the images that soft masks' groups paint."""
    return found.select("doc_id", F.explode("mask_images").alias("num")).join(images, ["doc_id", "num"]).select(*_KEY).distinct()


def gray_plan(images: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, num, gen, residual (null: eligible) of the images that show colour. kept, groups: keys of preserved images
    and of those in mask groups."""
    colour = ~F.coalesce(F.col("is_mask"), F.lit(False)) & ~F.coalesce((F.col("channels") == 1) & ~F.col("color_space").startswith("Indexed"), F.lit(False))
    rows = images.where(colour).join(kept.withColumn("_kept", F.lit(True)), _KEY, "left").join(groups.withColumn("_group", F.lit(True)), _KEY, "left")
    residual = (
        F.when(F.col("_kept"), "preserved_stamp")
        .when(F.col("_group"), "mask_group")
        .when(~identity_decode(F.col("decode")), "decode")
        .when(F.col("has_color_key"), "color_key_mask")
        .when(unsupported_reason().isNotNull(), "image_unsupported")
    )
    return rows.select(*_KEY, residual.alias("residual"))


def gray_summary(plan: DataFrame, page_text: DataFrame) -> DataFrame:
    """Per file: eligible images, residual images by reason, and the pages (from 1) with colour images in their content."""
    counts = plan.groupBy("doc_id").agg(F.count_if(F.col("residual").isNull()).alias("eligible"), *[F.count_if(F.col("residual") == r).alias(r) for r in RESIDUALS])
    pages = page_text.where("inline_color > 0").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("page_no") + 1)).alias("inline_pages"))
    return counts.join(pages, "doc_id", "full_outer")
