"""The image plan: every decision about an image that needs no pixels, as columns.

One row per image: effective DPI, whether and why it is left alone, target size, estimated work, and its batch. Python
decodes pixels only for the rows whose plan asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import CompressOptions

#: Dpi headroom, largest side, bytes a pixel, copies at work, perceptual gate.
HEADROOM, MAX_SIDE, PIXEL_BYTES, COPIES, COPIES_PERCEPTUAL = 1.05, 100_000, 8, 3, 5
PERCEPTUAL_SIDE, PERCEPTUAL_BYTES = 64, 10_240
#: Small stamps that are preserved.
STAMP_SIDE, STAMP_BYTES, STAMP_TOTAL = 300, 51_200, 1 << 20
#: Evidence of a scanned page.
SCAN_SIDE, SCAN_COVER, SCAN_TEXT = 400, 0.80, 32
#: Reasons in the order of reports.
REASONS = ("invalid_dimensions", "memory_limit", "jpx", "ccitt", "jbig2", "lzw", "indexed_sub_byte", "unsupported_bit_depth", "unsupported_color_space", "decode_failed", "soft_mask_matte", "soft_mask_uninspectable", "soft_mask_unsupported", "embedded_alpha_with_soft_mask", "non_gray_soft_mask", "encode_failed", "rewrite_failed")
_KEY = ["doc_id", "num", "gen"]


def nearest_resources(resources: DataFrame) -> DataFrame:
    """For each page, category and name the object of the nearest level."""
    order = Window.partitionBy("doc_id", "page_no", "category", "name").orderBy("depth")
    return resources.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at", "depth")


def effective_dpi(a: Column, b: Column, c: Column, d: Column, width: Column, height: Column) -> Column:
    """Single precision at each step; null where an extent is zero."""
    f = lambda x: x.cast("float")
    wide, high = f(f(F.hypot(a, b)) / F.lit(72)), f(f(F.hypot(c, d)) / F.lit(72))
    return F.when((wide > 0) & (high > 0), F.greatest(f(f(width) / wide), f(f(height) / high)))


def placed_images(placements: DataFrame, resources: DataFrame, images: DataFrame) -> DataFrame:
    """Each painting of an image: its dpi and painted area."""
    named = nearest_resources(resources).where("category = 'XObject'").drop("category")
    hits = placements.join(named, ["doc_id", "page_no", "name"]).join(images.select(*_KEY, "width", "height"), _KEY)
    dpi = effective_dpi(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("width"), F.col("height"))
    area = F.abs((F.col("a") * F.col("d") - F.col("b") * F.col("c")).cast("float"))
    return hits.withColumn("dpi", dpi).withColumn("area", area)


def max_dpi(placed: DataFrame) -> DataFrame:
    return placed.groupBy(*_KEY).agg(F.max("dpi").alias("dpi"))


def scanned_pages(placed: DataFrame, pages: DataFrame, page_text: DataFrame) -> DataFrame:
    """doc_id, page_no, scanned for every page."""
    large = placed.where((F.col("width") >= SCAN_SIDE) & (F.col("height") >= SCAN_SIDE)).groupBy("doc_id", "page_no").agg(F.max("area").alias("area"))
    box = F.coalesce("crop_box", "media_box")
    area = F.abs((box[2] - box[0]) * (box[3] - box[1])).cast("float")
    rows = pages.join(large, ["doc_id", "page_no"], "left").join(page_text.select("doc_id", "page_no", "text_bytes"), ["doc_id", "page_no"], "left")
    cover = (F.col("area") / area).cast("float") >= F.lit(SCAN_COVER).cast("float")
    return rows.select("doc_id", "page_no", F.coalesce((area > 0) & cover & (F.col("text_bytes") <= SCAN_TEXT), F.lit(False)).alias("scanned"))


def soft_masks(images: DataFrame, refs: DataFrame) -> DataFrame:
    """Images that another image names as its /SMask."""
    used = refs.where(F.array_join("path", "/") == "SMask").join(images.select("doc_id", F.col("num").alias("src_num"), F.col("gen").alias("src_gen")), ["doc_id", "src_num", "src_gen"], "left_semi")
    used = used.select("doc_id", F.col("dst_num").alias("num"), F.col("dst_gen").alias("gen")).distinct()
    return images.select(*_KEY).join(used, _KEY, "left_semi")


def preserved(images: DataFrame, found: DataFrame) -> DataFrame:
    """Images of signature appearances, and small stamps unless a document's stamps exceed the total."""
    shown = found.select("doc_id", F.explode("form_images").alias("num")).join(images, ["doc_id", "num"]).select(*_KEY)
    sides = (F.least("width", "height") > 0) & F.col("width").isNotNull() & F.col("height").isNotNull() & (F.greatest("width", "height") <= STAMP_SIDE)
    small = images.where(sides & (F.col("stream_len") <= STAMP_BYTES))
    small = small.withColumn("total", F.sum("stream_len").over(Window.partitionBy("doc_id"))).where(F.col("total") <= STAMP_TOTAL)
    return shown.unionByName(small.select(*_KEY)).distinct()


def unsupported_reason() -> Column:
    """Why an image cannot be decoded here; null if it can. The first reason that holds."""
    has = lambda *names: F.lit(False) if not names else F.arrays_overlap("filters", F.array(*map(F.lit, names)))
    indexed = F.coalesce(F.col("color_space").startswith("Indexed/"), F.lit(False))
    plain = F.coalesce(F.col("color_space").isin("DeviceRGB", "DeviceGray", "DeviceCMYK", "ICCBased") & F.col("channels").isNotNull(), F.lit(False))
    palette = indexed & F.col("channels").isin(1, 3) & (F.col("palette_bytes") == (F.col("hival") + 1) * F.col("channels"))
    jpeg = F.element_at(F.col("filters"), -1).isin("DCTDecode", "DCT")
    return (
        F.when(has("JPXDecode"), "jpx")
        .when(has("CCITTFaxDecode", "CCF"), "ccitt")
        .when(has("JBIG2Decode"), "jbig2")
        .when(has("LZWDecode", "LZW"), "lzw")
        .when(F.coalesce(jpeg, F.lit(False)), F.lit(None))
        .when(indexed & F.col("bits").isin(1, 2, 4), "indexed_sub_byte")
        .when(F.coalesce(F.col("bits") != 8, F.lit(True)), "unsupported_bit_depth")
        .when(~(plain | F.coalesce(palette, F.lit(False))), "unsupported_color_space")
    )


def guard_reason(options: CompressOptions) -> Column:
    """Why an image is left alone before its pixels are looked at, in the order of the checks."""
    side = lambda x: F.coalesce((F.col(x) <= 0) | (F.col(x) > MAX_SIDE), F.lit(False))
    estimate = F.col("width").cast("decimal(38,0)") * F.col("height") * PIXEL_BYTES
    over = F.lit(False) if options.max_image_bytes is None else estimate > options.max_image_bytes
    return (
        F.when((F.col("smask") == "stream") & F.col("has_matte"), "soft_mask_matte")
        .when(F.col("smask") == "unresolved", "soft_mask_uninspectable")
        .when(F.col("smask") == "direct", "soft_mask_unsupported")
        .when(F.col("width").isNull() | F.col("height").isNull(), "invalid_dimensions")
        .when(side("width") | side("height"), "invalid_dimensions")
        .when(over, "memory_limit")
        .otherwise(unsupported_reason())
    )


def target_side(side: Column, dpi: Column, target: int) -> Column:
    scale = (F.lit(target).cast("float") / dpi).cast("float")
    return F.greatest(F.lit(1), F.floor(side.cast("float") * scale + 0.5).cast("long"))


def working_bytes(options: CompressOptions) -> Column:
    """Estimated bytes at work for one image, at least 1, at most 2**63 - 1."""
    copies = COPIES if options.quality_target is None else COPIES_PERCEPTUAL
    total = F.coalesce(F.greatest("width", F.lit(0)), F.lit(0)).cast("decimal(38,0)") * F.coalesce(F.greatest("height", F.lit(0)), F.lit(0)) * (PIXEL_BYTES * copies) + 2 * F.col("stream_len")
    return F.least(F.greatest(total, F.lit(1).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def image_plan(images: DataFrame, placed: DataFrame, masks: DataFrame, kept: DataFrame, options: CompressOptions = CompressOptions()) -> DataFrame:
    """One row per image with every gate evaluated. action: preserved, skipped or candidate.

    What holds for a lossless source that leaves as JPEG, which only its pixels tell, stands beside in columns named first_*.
    """
    target, quality = options.resolved()
    rows = images.join(max_dpi(placed), _KEY, "left")
    rows = rows.join(masks.withColumn("is_soft_mask", F.lit(True)), _KEY, "left").join(kept.withColumn("is_preserved", F.lit(True)), _KEY, "left")
    rows = rows.withColumns({"is_soft_mask": F.coalesce("is_soft_mask", F.lit(False)), "is_preserved": F.coalesce("is_preserved", F.lit(False))})
    reason = F.when(~F.col("is_preserved"), guard_reason(options))
    rows = rows.withColumn("skip_reason", reason).withColumn("action", F.when(F.col("is_preserved"), "preserved").when(F.col("skip_reason").isNotNull(), "skipped").otherwise("candidate"))
    lossless = ~F.coalesce(F.element_at("filters", -1).isin("DCTDecode", "DCT"), F.lit(False))

    def shrunk(dpi: int, first: str = "") -> dict[str, Column]:
        above = F.coalesce(F.col("dpi") > (F.lit(dpi).cast("float") * F.lit(HEADROOM).cast("float")).cast("float"), F.lit(False))
        down = F.lit(options.downsample) & ~F.col("is_soft_mask") & above & (F.col("action") == "candidate")
        size = lambda x: F.when(down, target_side(F.col(x), F.col("dpi"), dpi)).otherwise(F.col(x))
        return {f"{first}target_dpi": F.lit(dpi), f"{first}downsample": down, f"{first}target_width": size("width"), f"{first}target_height": size("height")}

    rows = rows.withColumns(shrunk(target) | shrunk(options.transcode_dpi or target, "first_"))
    rows = rows.withColumns({"lossless": lossless, "quality": F.lit(quality), "first_quality": F.lit(options.transcode_quality or quality), "work": working_bytes(options)})
    gate = F.lit(options.quality_target is not None) & (F.least("width", "height") >= PERCEPTUAL_SIDE) & (F.col("stream_len") >= PERCEPTUAL_BYTES)
    return rows.withColumn("perceptual", F.coalesce(gate, F.lit(False)))


def batches(plan: DataFrame, budget: int | None, most: int | None) -> DataFrame:
    """doc_id, batch, first, last (places in id order), images, work.

    Greedy in id order: an image that would exceed the budget or the count opens a new batch; one above the budget alone
    has a batch of its own. The reset depends on the data, so it is a fold over the ordered array.
    """
    top = F.lit((1 << 62) if budget is None else max(1, budget))
    count = F.lit((1 << 30) if most is None else max(1, most))
    rows = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("num", "gen", "work"))).alias("items"))
    item = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("work"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<batch:bigint,work:bigint>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        fresh = (a["n"] > 0) & ((a["work"] + x["work"] > top) | (a["n"] >= count))
        number = a["batch"] + F.when(fresh, 1).otherwise(0)
        own = F.struct(number.cast("long").alias("batch"), x["work"].alias("work"))
        return F.struct(number.cast("long").alias("batch"), F.when(fresh, x["work"]).otherwise(a["work"] + x["work"]).cast("long").alias("work"), F.when(fresh, 1).otherwise(a["n"] + 1).cast("long").alias("n"), F.concat(a["out"], F.array(own)).alias("out"))

    done = rows.select("doc_id", F.posexplode(F.aggregate("items", item, add)["out"]).alias("place", "b"))
    return done.groupBy("doc_id", F.col("b.batch").alias("batch")).agg(F.min("place").cast("long").alias("first"), F.max("place").cast("long").alias("last"), F.count("*").alias("images"), F.sum("b.work").alias("work"))


def reason_rank(reason: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, REASONS)), reason)


def skip_summary(plan: DataFrame) -> DataFrame:
    rows = plan.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("images"), F.sum("stream_len").alias("input_bytes"))
    return rows.orderBy(reason_rank(F.col("skip_reason")))


def duplicate_images(images: DataFrame, masks: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, num, canonical: images with the same bytes and rendering as one of a lower id, which stands for them."""
    free = images.where("smask IS NULL").join(masks, _KEY, "left_anti").join(kept, _KEY, "left_anti")
    same = Window.partitionBy("doc_id", "content_sha", "stream_len", "render_key")
    rows = free.withColumn("_first", F.min(F.struct("num", "gen")).over(same))
    return rows.where(F.col("num") != F.col("_first.num")).select("doc_id", "num", F.col("_first.num").alias("canonical"), "stream_len")
