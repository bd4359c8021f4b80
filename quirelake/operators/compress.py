"""Compression of a table of files: the plan is columns, Python touches only bytes.

files -> one parse -> image plan and document decisions in Catalyst -> one Arrow pass that carries the plan of each file ->
output bytes and statistics. A file above a limit, encrypted or broken is a row that keeps its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions import rewrite
from ..options import CompressOptions
from ..plans.iterate import checkpoint, small
from ..sources.made import Made, over
from ..sources.tables import facts, section
from . import documents as D
from . import grayscale as G
from . import images as I

RESULT = "doc_id long, status string, error string, pages int, is_signed boolean, input_bytes long, output_bytes long, content binary, flattened int, deduplicated int, gray int, gray_oversize int, gray_unapplied boolean, fonts_subset int, modified boolean, images array<struct<num:int,action:string,skip_reason:string,input_bytes:long,output_bytes:long>>"
_PLAN = ["num", "gen", "action", "skip_reason", "stream_len", "filters", "smask", "decode", "has_color_key", "is_soft_mask", "lossless", "downsample", "target_width", "target_height", "quality", "first_downsample", "first_target_width", "first_target_height", "first_quality", "turns_gray"]


def planned(files: DataFrame | Made, options: CompressOptions) -> DataFrame:
    """doc_id, status, error, pages, is_signed and the images' plan of each file."""
    found = checkpoint(facts(files, "objects(kind, type, has_byte_range)", "images", "placements", "resources", "soft_masks"))
    images = section(found, "images")
    placed = I.placed_images(section(found, "placements"), section(found, "resources"), images)
    kept = I.preserved(images, found)
    plan = I.image_plan(images, placed, I.soft_masks(images, section(found, "soft_masks")), kept, options)
    if options.grayscale:
        eligible = G.gray_plan(images, kept, G.mask_groups(images, found)).where("residual IS NULL").select("doc_id", "num", "gen", F.lit(True).alias("turns_gray"))
        plan = plan.join(eligible, ["doc_id", "num", "gen"], "left").withColumn("turns_gray", F.coalesce("turns_gray", F.lit(False)))
    else:
        plan = plan.withColumn("turns_gray", F.lit(False))
    limits = D.limit_rejections(found, D.document_work(plan), options).select("doc_id", F.format_string("limit: %s %d > %d", "kind", "observed", "allowed").alias("limit"))
    rows = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*_PLAN))).alias("plan"))
    out = found.select("doc_id", "status", "error", F.col("page_count").alias("pages"), D.is_signed().alias("is_signed")).join(rows, "doc_id", "left").join(limits, "doc_id", "left")
    return out.withColumn("status", F.when(F.col("limit").isNotNull(), "limit").otherwise(F.col("status"))).withColumn("error", F.coalesce("limit", "error")).drop("limit")


def compress(files: DataFrame | Made, options: CompressOptions = CompressOptions()) -> DataFrame:
    # plans are small beside bytes: they go to the files' rows, which stay where they are while the plans fit
    plans = checkpoint(planned(files, options))
    return rewritten(files.select("doc_id", "content").join(small(plans, "200 + 256 * coalesce(size(plan), 0)"), "doc_id"), options)


def rewritten(both: DataFrame | Made, options: CompressOptions = CompressOptions(), keep: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """The result of `compress` from files whose rows hold their plans; and columns as they were (keep: new name to name).

    Where files are made from smaller rows, the plans can join those, so that no file's bytes are shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _parse_datatype_string(RESULT)
    arrow = to_arrow_schema(schema)
    for name, old in keep.items():
        schema.add(name, both.schema[old].dataType)
    own = ["doc_id", "status", "error", "pages", "is_signed", "plan", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                rows = [_rewritten({k: x.as_py() for k, x in zip(own, values, strict=True)}, options) for values in zip(*part.columns[: len(own)], strict=True)]
                yield pa.RecordBatch.from_arrays(pa.RecordBatch.from_pylist(rows, arrow).columns + part.columns[len(own) :], names=schema.names)

    return over(both, [*own, *keep.values()], run, schema)


def _rewritten(r: dict, options: CompressOptions) -> dict:
    data, plan = r.pop("content"), r.pop("plan") or []
    row = r | {"input_bytes": len(data), "content": data, "flattened": 0, "deduplicated": 0, "gray": 0, "gray_oversize": 0, "gray_unapplied": False, "fonts_subset": 0, "modified": False, "images": []}
    if r["status"] == "ok":
        try:
            row |= rewrite.compress(data, plan, options, bool(r["is_signed"]))
        except (ValueError, TypeError, KeyError, IndexError, RecursionError) as e:
            row |= {"status": "rewrite_failed", "error": str(e)[:200]}
    return row | {"output_bytes": len(row["content"])}


def report_json(result: DataFrame, policy: str | None, details: bool = False) -> DataFrame:
    """doc_id and the versioned report as JSON; keys that do not apply are left out."""
    by = lambda a: F.size(F.filter("images", lambda i: i["action"] == a))
    reasons = F.array_sort(F.array_distinct(F.transform(F.filter("images", lambda i: i["skip_reason"].isNotNull()), lambda i: i["skip_reason"])))
    of = lambda r: F.filter("images", lambda i: i["skip_reason"] == r)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, i: a + i["input_bytes"])
    rows = D.report(result, policy)
    detail = [F.col("images").alias("detail")] if details else []
    body = F.struct(
        F.lit(1).alias("report_schema_version"),
        F.struct(F.col("input_bytes").alias("bytes"), "pages").alias("input"),
        F.struct(F.col("output_bytes").alias("bytes"), D.ratio(F.col("output_bytes"), F.col("input_bytes")).alias("ratio")).alias("output"),
        F.struct("is_signed", F.lit(policy).alias("signature_policy"), F.col("flattened").alias("flattened_signatures"), "visual_appearance_preserved", "cryptographic_validity_preserved", "operation_blocked", "document_modified").alias("document"),
        F.struct(
            F.size("images").alias("total"),
            F.struct(*[by(a).alias(a) for a in ("recompressed", "downsampled", "kept", "skipped", "preserved")]).alias("by_action"),
            "deduplicated",
            F.transform(reasons, lambda r: F.struct(r.alias("reason"), F.size(of(r)).alias("images"), total(of(r)).alias("input_bytes"))).alias("skipped_by_reason"),
            *detail,
        ).alias("images"),
    )
    return rows.select("doc_id", F.to_json(body).alias("report"))


def corpus_totals(result: DataFrame) -> DataFrame:
    """One row per file and one of totals (doc_id null)."""
    by = lambda a: F.size(F.filter("images", lambda i: i["action"] == a))
    actions = ("recompressed", "downsampled", "kept", "skipped", "preserved")
    rows = result.select("doc_id", "input_bytes", "output_bytes", *[by(a).alias(a) for a in actions])
    return rows.rollup("doc_id").agg(F.sum("input_bytes").alias("input_bytes"), F.sum("output_bytes").alias("output_bytes"), *[F.sum(a).alias(a) for a in actions])
