"""Questions about whole documents: signatures, limits, reports, reachability, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import CompressOptions


def signed(found: DataFrame, objects: DataFrame) -> DataFrame:
    """doc_id, is_signed: a /ByteRange, a signature or time stamp dictionary, or SigFlags other than 0. When in doubt, true."""
    marks = objects.groupBy("doc_id").agg(F.bool_or(F.col("has_byte_range") | (F.coalesce(F.col("type").isin("Sig", "DocTimeStamp"), F.lit(False)) & (F.col("kind") == "dict"))).alias("marked"))
    rows = found.where("status = 'ok'").select("doc_id", "sig_nonzero").join(marks, "doc_id", "left")
    return rows.select("doc_id", (F.coalesce("marked", F.lit(False)) | F.col("sig_nonzero")).alias("is_signed"))


def is_signed() -> Column:
    """`signed` of a file's own row, which holds kind, type and has_byte_range of its objects."""
    mark = lambda o: F.coalesce(o["has_byte_range"] | (F.coalesce(o["type"].isin("Sig", "DocTimeStamp"), F.lit(False)) & (o["kind"] == "dict")), F.lit(False))
    return F.when(F.col("status") == "ok", F.exists("objects", mark) | F.col("sig_nonzero"))


def signature_indicators(found: DataFrame) -> DataFrame:
    """The three marks of the editing side; SigFlags counts by its first bit there."""
    return found.where("status = 'ok'").select("doc_id", "sig_flags", "sig_field", "perms", (F.col("sig_flags") | F.col("sig_field") | F.col("perms")).alias("any"))


def limit_rejections(found: DataFrame, work: DataFrame, options: CompressOptions) -> DataFrame:
    """doc_id, kind, observed, allowed of documents above a limit; the first of pages, objects, work. Equal is accepted."""
    rows = found.where("status = 'ok'").select("doc_id", "page_count", "object_count").join(work, "doc_id", "left")
    checks = [("pages", "page_count", options.max_pages), ("objects", "object_count", options.max_objects), ("total_work", "work", options.max_total_work_bytes)]
    hits = [F.when(F.col(c) > limit, F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("observed"), F.lit(limit).cast("long").alias("allowed"))) for k, c, limit in checks if limit is not None]
    if not hits:
        hits = [F.lit(None).cast("struct<kind:string,observed:bigint,allowed:bigint>")]
    return rows.select("doc_id", F.coalesce(*hits).alias("_hit")).where("_hit IS NOT NULL").select("doc_id", "_hit.*")


def document_work(plan: DataFrame) -> DataFrame:
    total = F.sum(F.col("work").cast("decimal(38,0)"))
    return plan.groupBy("doc_id").agg(F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("work"))


def rotation(raw: Column, turn: Column) -> Column:
    """To whole quarter turns, plus the turn, within a full one."""
    return F.pmod((F.round(raw / 90).cast("long") * 90 + turn).cast("long"), F.lit(360).cast("long"))


def plain_pages(pages: DataFrame, for_replacement: bool = False) -> Column:
    """Upright, unscaled, with boxes from the origin (within a hundredth of a point)."""
    corner = lambda c: c.isNotNull() & (F.abs(F.least(c[0], c[2]) if not for_replacement else c[0]) <= 0.01) & (F.abs(F.least(c[1], c[3]) if not for_replacement else c[1]) <= 0.01)
    unit = F.lit(True) if for_replacement else F.col("user_unit") == 1
    return (F.pmod(F.col("rotate"), F.lit(360)) == 0) & unit & corner(F.col("media_box")) & (F.col("crop_box").isNull() | corner(F.col("crop_box")))


def shared_streams(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, others: pages that share a content stream with this one."""
    ids = pages.select("doc_id", "page_no", F.explode(F.array_distinct("content_ids")).alias("id"))
    other = ids.select("doc_id", "id", F.col("page_no").alias("other"))
    hits = ids.join(other, ["doc_id", "id"]).where("page_no <> other")
    return hits.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_set("other")).alias("others"))


def unreachable(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Objects that no chain of references from the trailer reaches.

    Breadth first over all documents at once: as many rounds as the deepest document has levels.
    """
    from ..plans.iterate import until_stable

    edges = refs.select("doc_id", F.col("src_num").alias("num"), F.col("dst_num").alias("to")).distinct()
    roots = edges.where("num = 0").select("doc_id", F.col("to").alias("num")).distinct()
    step = lambda front: front.join(edges, ["doc_id", "num"]).select("doc_id", F.col("to").alias("num")).distinct()
    reached = until_stable(roots, step)
    return objects.select("doc_id", "num", "gen").join(reached, ["doc_id", "num"], "left_anti")


def duplicate_streams(objects: DataFrame) -> DataFrame:
    """doc_id, num, canonical: streams with the bytes and dictionary of one of a lower id."""
    same = Window.partitionBy("doc_id", "content_sha", "stream_len", "dict_key")
    rows = objects.where("kind = 'stream'").withColumn("_first", F.min(F.struct("num", "gen")).over(same))
    return rows.where(F.col("num") != F.col("_first.num")).select("doc_id", "num", F.col("_first.num").alias("canonical"), "stream_len")


def remapped(refs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """References with duplicates replaced by their canonical object."""
    to = duplicates.select("doc_id", F.col("num").alias("dst_num"), "canonical")
    return refs.join(to, ["doc_id", "dst_num"], "left").withColumn("dst_num", F.coalesce("canonical", "dst_num")).drop("canonical")


def duplicate_files(files: DataFrame) -> DataFrame:
    """Groups of files with the same bytes: size, files, bytes that could be saved."""
    groups = files.groupBy(F.sha2("content", 256).alias("content_sha"), "length").agg(F.count("*").alias("files"), F.min("doc_id").alias("canonical"))
    return groups.where("files > 1").withColumn("redundant_bytes", (F.col("files") - 1) * F.col("length"))


def duplicate_potential(objects: DataFrame) -> DataFrame:
    """Per document, groups of equal streams and the bytes that repeat."""
    groups = objects.where("kind = 'stream'").groupBy("doc_id", "content_sha", "stream_len").agg(F.count("*").alias("n"))
    return groups.where("n > 1").groupBy("doc_id").agg(F.count("*").alias("groups"), F.sum((F.col("n") - 1) * F.col("stream_len")).alias("redundant_bytes"))


def reflatable(objects: DataFrame, least: int = 51_200) -> DataFrame:
    """Streams that another zlib pass may shrink."""
    return objects.where(F.col("is_plain_flate") & (F.coalesce("subtype", F.lit("")) != "Image") & (F.col("stream_len") >= least)).select("doc_id", "num", "stream_len")


def ratio(out: Column, size: Column) -> Column:
    return (out.cast("float") / F.nullif(size, F.lit(0)).cast("float")).cast("float")


def report(rows: DataFrame, policy: str | None) -> DataFrame:
    """Flags of the versioned report. rows: is_signed, flattened, gray_unapplied."""
    sig, gray = F.col("is_signed"), F.col("gray_unapplied")
    flat, strict = F.lit(policy == "flatten"), F.lit(policy == "strict")
    blocked = sig & strict
    return rows.withColumns({
        "visual_appearance_preserved": ~sig | flat | strict | gray,
        "cryptographic_validity_preserved": ~sig | strict | gray,
        "operation_blocked": blocked,
        "document_modified": sig & F.lit(policy is not None) & ~blocked & ~gray,
    })
