"""Registered queries about files made from `documents`, each with the SQL over the rows that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import images as I
from ..options import CompressOptions
from ..sources import bridge
from ..sources.made import Made
from ..sources.tables import facts, section
from .iterate import checkpoint

#: The closed formulas of the files, for the SQL side.
BASE = """
WITH t AS (SELECT doc_id AS d, replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' ') AS t FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT d, t, CAST(length(t) AS BIGINT) AS n, CAST(greatest(1, ceil(length(t) / 80.0)) AS BIGINT) AS lines FROM t),
f AS (SELECT *, CAST(greatest(1, ceil(lines / 50.0)) AS BIGINT) AS pages, d % 4 AS k, 100 + 50 * (d % 7) AS w, d % 97 = 96 AS encrypted FROM l),
ok AS (SELECT * FROM f WHERE NOT encrypted),
img AS (SELECT ok.*, j, (d + j % 2) % 5 AS kind FROM ok, LATERAL (SELECT unnest(range(k)) AS j) s)
"""


def documents(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def files(spark, sf_dir) -> Made:
    return bridge.made(documents(spark, sf_dir))


#: What tells that a file is signed.
SIGNS = "objects(kind, type, has_byte_range)"


def _found(spark, sf_dir, *sections):
    """Several sections are read by several branches: they share one parse through a checkpoint."""
    found = facts(files(spark, sf_dir), *sections)
    return checkpoint(found) if len(sections) > 1 else found


def _pictures(spark, sf_dir):
    """(all, images, placed) of one parse, kept for the joins below it."""
    found = _found(spark, sf_dir, "images(num, gen, width, height)", "placements", "resources")
    images = section(found, "images")
    return found, images, I.placed_images(section(found, "placements"), section(found, "resources"), images)


def doc_profile(spark, sf_dir):
    found = _found(spark, sf_dir, SIGNS, "images(num, gen, width, height)", "placements", "resources")
    images = section(found, "images")
    dpi = I.max_dpi(I.placed_images(section(found, "placements"), section(found, "resources"), images)).groupBy("doc_id").agg(F.max("dpi").cast("double").alias("max_dpi"))
    return found.select("doc_id", "status", F.col("page_count").cast("long").alias("pages"), F.when(F.col("status") == "ok", F.size("images")).cast("long").alias("images"), D.is_signed().alias("is_signed")).join(dpi, "doc_id", "left")


def parse_status(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("status").agg(F.count("*").alias("files"))


def page_rotation(spark, sf_dir):
    pages = section(_found(spark, sf_dir, "pages(rotate)"), "pages")
    return pages.groupBy(D.rotation(F.col("rotate"), F.lit(0)).alias("rotation")).agg(F.count("*").alias("pages"))


def object_counts(spark, sf_dir):
    return section(_found(spark, sf_dir, "objects(num)"), "objects").groupBy("doc_id").agg(F.count("*").alias("objects"))


def image_effective_dpi(spark, sf_dir):
    _, _, placed = _pictures(spark, sf_dir)
    return I.max_dpi(placed).select("doc_id", F.col("num").cast("long").alias("num"), F.col("dpi").cast("double").alias("dpi")).drop("num")


#: What the image plan looks at.
PLANNED = "images(num, gen, width, height, bits, filters, color_space, channels, hival, palette_bytes, smask, has_matte, decode, has_color_key, stream_len)"


def _plan(spark, sf_dir, options=CompressOptions()):
    found = _found(spark, sf_dir, PLANNED, "placements", "resources", "soft_masks")
    images = section(found, "images")
    placed = I.placed_images(section(found, "placements"), section(found, "resources"), images)
    return found, images, I.image_plan(images, placed, I.soft_masks(images, section(found, "soft_masks")), I.preserved(images, found), options)


def downsample_candidates(spark, sf_dir):
    _, _, plan = _plan(spark, sf_dir)
    return plan.where("downsample").groupBy("doc_id").agg(F.count("*").alias("images"), F.min("target_width").cast("long").alias("target_width"))


def skip_summary(spark, sf_dir):
    _, _, plan = _plan(spark, sf_dir)
    return I.skip_summary(plan)


def action_histogram(spark, sf_dir):
    _, _, plan = _plan(spark, sf_dir)
    return plan.groupBy("doc_id").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("preserved", "skipped", "candidate")])


def work_estimate(spark, sf_dir):
    _, _, plan = _plan(spark, sf_dir)
    return D.document_work(plan)


def batch_plan(spark, sf_dir):
    _, _, plan = _plan(spark, sf_dir)
    return I.batches(plan, 3_000_000, 2).select("doc_id", "batch", "images", "work")


def limit_rejections(spark, sf_dir):
    found, _, plan = _plan(spark, sf_dir)
    return D.limit_rejections(found, D.document_work(plan), CompressOptions(max_pages=1, max_objects=12, max_total_work_bytes=3_000_000))


def duplicate_images(spark, sf_dir):
    images = section(_found(spark, sf_dir, "images(num, gen, smask, stream_len, content_sha, render_key)"), "images")
    none = images.select("doc_id", "num", "gen").where("false")
    return I.duplicate_images(images, none, none).groupBy("doc_id").agg(F.count("*").alias("images"))


def duplicate_documents(spark, sf_dir):
    """Texts that occur more than once, as files of one number would."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    same = docs.select(F.col("doc_id"), F.encode("text", "UTF-8").alias("content")).withColumn("length", F.length("content").cast("long"))
    return D.duplicate_files(same).select("canonical", "files", "length", "redundant_bytes")


def unreachable_objects(spark, sf_dir):
    found = _found(spark, sf_dir, "objects(num, gen)", "refs(src_num, dst_num)")
    return D.unreachable(section(found, "objects"), section(found, "refs")).groupBy("doc_id").agg(F.count("*").alias("objects"))


def signature_report(spark, sf_dir):
    found = _found(spark, sf_dir, SIGNS).where("status = 'ok'")
    rows = found.select(D.is_signed().alias("is_signed")).withColumn("gray_unapplied", F.lit(False))
    policies, flags = ("flatten", "strict", "ignore"), ("visual_appearance_preserved", "cryptographic_validity_preserved", "operation_blocked", "document_modified")
    # the flags follow from is_signed: the files are counted by it, once for all policies
    counts, out = checkpoint(rows.groupBy("is_signed", "gray_unapplied").agg(F.count("*").alias("n"))), None
    for policy in policies:
        own = D.report(counts, policy).groupBy(F.lit(policy).alias("policy")).agg(*[F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in flags])
        out = own if out is None else out.unionByName(own)
    return out


def plain_page_geometry(spark, sf_dir):
    pages = section(_found(spark, sf_dir, "pages"), "pages")
    return pages.groupBy("doc_id").agg(F.count_if(D.plain_pages(pages)).alias("plain_pages"))


def shared_content_streams(spark, sf_dir):
    """No two pages of these files share a stream: the join with pages as listed twice shows each page's own."""
    pages = checkpoint(section(_found(spark, sf_dir, "pages(page_no, content_ids)"), "pages"))  # one parse for the four uses
    twice = pages.unionByName(pages.withColumn("page_no", F.col("page_no") + 1000))
    return D.shared_streams(twice).where("page_no < 1000").groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.element_at("others", 1) - 1000).cast("long").alias("other_sum"))


def outline_targets(spark, sf_dir):
    items = section(_found(spark, sf_dir, "outline(dest_page)"), "outline")
    return items.groupBy("doc_id").agg(F.count("*").alias("items"), F.sum("dest_page").cast("long").alias("page_sum"))


def link_targets(spark, sf_dir):
    links = section(_found(spark, sf_dir, "annotations(page_no, dest_page)"), "annotations")
    return links.where("dest_page = page_no + 1").groupBy("doc_id").agg(F.count("*").alias("links"))


def page_text_bytes(spark, sf_dir):
    rows = section(_found(spark, sf_dir, "page_text(page_no, text_bytes)"), "page_text")
    return rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text_bytes")


def operator_counts(spark, sf_dir):
    ops = section(_found(spark, sf_dir, "ops(operator)"), "ops")
    return ops.groupBy("operator").agg(F.count("*").alias("n"))


def scanned_documents(spark, sf_dir):
    found = _found(spark, sf_dir, "images(num, gen, width, height)", "placements", "resources", "pages(page_no, media_box, crop_box)", "page_text(page_no, text_bytes)")
    placed = I.placed_images(section(found, "placements"), section(found, "resources"), section(found, "images"))
    pages = I.scanned_pages(placed, section(found, "pages"), section(found, "page_text"))
    return pages.groupBy("scanned").agg(F.count("*").alias("pages"))


def corpus_report(spark, sf_dir):
    """One row for each file, and the corpus's totals in a last one: a rollup."""
    found = _found(spark, sf_dir, "images(num)")
    rows = found.select("doc_id", F.coalesce("page_count", F.lit(0)).cast("long").alias("pages"), F.greatest(F.lit(0), F.coalesce(F.size("images"), F.lit(0))).cast("long").alias("images"), (F.col("status") != "ok").cast("long").alias("failed"))
    return rows.rollup("doc_id").agg(F.sum("pages").alias("pages"), F.sum("images").alias("images"), F.sum("failed").alias("failed"))


def with_lengths(sql: str) -> str:
    """The formulas with `img` that also has the bytes of each image's stream, which no formula gives, and what stamps are."""
    rows = ", ".join(f"({k}, {w}, {s}, {n})" for (k, w, s), n in sorted(bridge.stream_lengths().items()))
    more = f""", len(kind, w, seed, n_bytes) AS (VALUES {rows}), pic AS (
  SELECT img.d, img.j, img.kind, img.w, img.k, img.pages, len.n_bytes, img.w <= 300 AND len.n_bytes <= 51200 AS small,
    coalesce(sum(len.n_bytes) FILTER (img.w <= 300 AND len.n_bytes <= 51200) OVER (PARTITION BY img.d), 0) <= 1048576 AS few
  FROM img JOIN len ON len.kind = img.kind AND len.w = img.w AND len.seed = img.j % 2
), p AS (SELECT *, small AND few AS preserved, w * w * 24 + 2 * n_bytes AS work FROM pic)
"""
    return BASE + more + sql


QUERIES = {f.__name__: f for f in (doc_profile, parse_status, page_rotation, object_counts, image_effective_dpi, downsample_candidates, skip_summary, action_histogram, work_estimate, batch_plan, limit_rejections, duplicate_images, duplicate_documents, unreachable_objects, signature_report, plain_page_geometry, shared_content_streams, outline_targets, link_targets, page_text_bytes, operator_counts, scanned_documents, corpus_report)}

SQL = {
    "doc_profile": BASE + "SELECT d AS doc_id, CASE WHEN encrypted THEN 'encrypted' ELSE 'ok' END AS status, CASE WHEN NOT encrypted THEN pages END AS pages, CASE WHEN NOT encrypted THEN k END AS images, CASE WHEN NOT encrypted THEN d % 11 = 0 END AS is_signed, CASE WHEN NOT encrypted AND k > 0 THEN w / 2.0::DOUBLE END AS max_dpi FROM f",
    "parse_status": BASE + "SELECT CASE WHEN encrypted THEN 'encrypted' ELSE 'ok' END AS status, count(*) AS files FROM f GROUP BY 1",
    "page_rotation": BASE + "SELECT 90 * (d % 4) AS rotation, CAST(sum(pages) AS BIGINT) AS pages FROM ok GROUP BY 1",
    "object_counts": BASE + "SELECT d AS doc_id, 3 + k + 4 * pages + d % 3 AS objects FROM ok",
    "image_effective_dpi": BASE + "SELECT d AS doc_id, w / 2.0::DOUBLE AS dpi FROM img",
    "downsample_candidates": lambda: with_lengths("SELECT d AS doc_id, count(*) AS images, CAST(min(floor(w * (150 / (w / 2.0)) + 0.5)) AS BIGINT) AS target_width FROM p WHERE kind < 2 AND NOT preserved AND w / 2.0 > 150 * 1.05 GROUP BY 1"),
    "skip_summary": lambda: with_lengths("SELECT CASE kind WHEN 2 THEN 'jpx' WHEN 3 THEN 'ccitt' ELSE 'unsupported_bit_depth' END AS skip_reason, count(*) AS images, CAST(sum(n_bytes) AS BIGINT) AS input_bytes FROM p WHERE kind >= 2 AND NOT preserved GROUP BY kind"),
    "action_histogram": lambda: with_lengths("SELECT d AS doc_id, count(*) FILTER (preserved) AS preserved, count(*) FILTER (NOT preserved AND kind >= 2) AS skipped, count(*) FILTER (NOT preserved AND kind < 2) AS candidate FROM p GROUP BY 1"),
    "work_estimate": lambda: with_lengths("SELECT d AS doc_id, CAST(sum(work) AS BIGINT) AS work FROM p GROUP BY 1"),
    "batch_plan": lambda: with_lengths(""", step AS (
  SELECT d, j, work AS own, 0 AS batch, work, 1 AS n FROM p WHERE j = 0
  UNION ALL
  SELECT i.d, i.j, i.work, CASE WHEN s.work + i.work > 3000000 OR s.n >= 2 THEN s.batch + 1 ELSE s.batch END,
    CASE WHEN s.work + i.work > 3000000 OR s.n >= 2 THEN i.work ELSE s.work + i.work END,
    CASE WHEN s.work + i.work > 3000000 OR s.n >= 2 THEN 1 ELSE s.n + 1 END
  FROM step s JOIN p i ON i.d = s.d AND i.j = s.j + 1
) SELECT d AS doc_id, CAST(batch AS BIGINT) AS batch, count(*) AS images, CAST(sum(own) AS BIGINT) AS work FROM step GROUP BY 1, 2""").replace("WITH t AS", "WITH RECURSIVE t AS", 1),
    "limit_rejections": lambda: with_lengths(", o AS (SELECT ok.d, pages, 3 + k + 4 * pages + d % 3 AS objects, coalesce(w.work, 0) AS work FROM ok LEFT JOIN (SELECT d, CAST(sum(work) AS BIGINT) AS work FROM p GROUP BY 1) w USING (d)) SELECT d AS doc_id, CASE WHEN pages > 1 THEN 'pages' WHEN objects > 12 THEN 'objects' ELSE 'total_work' END AS kind, CASE WHEN pages > 1 THEN pages WHEN objects > 12 THEN objects ELSE work END AS observed, CAST(CASE WHEN pages > 1 THEN 1 WHEN objects > 12 THEN 12 ELSE 3000000 END AS BIGINT) AS allowed FROM o WHERE pages > 1 OR objects > 12 OR work > 3000000"),
    "duplicate_images": BASE + "SELECT d AS doc_id, CAST(count(*) - count(DISTINCT (kind, j % 2)) AS BIGINT) AS images FROM img GROUP BY 1 HAVING count(*) > count(DISTINCT (kind, j % 2))",
    "duplicate_documents": "SELECT min(doc_id) AS canonical, count(*) AS files, CAST(octet_length(encode(text)) AS BIGINT) AS length, CAST((count(*) - 1) * octet_length(encode(text)) AS BIGINT) AS redundant_bytes FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "unreachable_objects": BASE + "SELECT d AS doc_id, d % 3 AS objects FROM ok WHERE d % 3 > 0",
    "signature_report": BASE + ", s AS (SELECT d % 11 = 0 AS sig, p.policy FROM ok, (VALUES ('flatten'), ('strict'), ('ignore')) p(policy)) SELECT policy, count(*) FILTER (NOT sig OR policy IN ('flatten', 'strict')) AS visual_appearance_preserved, count(*) FILTER (NOT sig OR policy = 'strict') AS cryptographic_validity_preserved, count(*) FILTER (sig AND policy = 'strict') AS operation_blocked, count(*) FILTER (sig AND policy <> 'strict') AS document_modified FROM s GROUP BY 1",
    "plain_page_geometry": BASE + "SELECT d AS doc_id, CASE WHEN d % 4 = 0 THEN pages ELSE 0 END AS plain_pages FROM ok",
    "shared_content_streams": BASE + "SELECT d AS doc_id, pages, CAST(pages * (pages - 1) // 2 AS BIGINT) AS other_sum FROM ok",
    "outline_targets": BASE + "SELECT d AS doc_id, pages AS items, CAST(pages * (pages - 1) // 2 AS BIGINT) AS page_sum FROM ok",
    "link_targets": BASE + "SELECT d AS doc_id, pages - 1 AS links FROM ok WHERE pages > 1",
    "page_text_bytes": BASE + "SELECT d AS doc_id, p AS page_no, CAST(greatest(0, least(n, 4000 * (p + 1)) - 4000 * p) AS BIGINT) AS text_bytes FROM ok, LATERAL (SELECT unnest(range(pages)) AS p) s",
    "operator_counts": BASE + "SELECT o.operator, CAST(sum(CASE WHEN o.operator = 'Tj' THEN lines WHEN o.operator = 'T*' THEN lines - pages WHEN o.operator IN ('q', 'Q', 'cm', 'Do') THEN k ELSE pages END) AS BIGINT) AS n FROM ok, (VALUES ('Do'), ('Tj'), ('T*'), ('cm'), ('q'), ('Q'), ('BT'), ('ET'), ('Tf'), ('TL'), ('Td')) o(operator) GROUP BY 1 HAVING n > 0",
    "scanned_documents": BASE + "SELECT false AS scanned, CAST(sum(pages) AS BIGINT) AS pages FROM ok",
    "corpus_report": BASE + ", r AS (SELECT d, CASE WHEN encrypted THEN 0 ELSE pages END AS pages, CASE WHEN encrypted THEN 0 ELSE k END AS images, encrypted::BIGINT AS failed FROM f) SELECT d AS doc_id, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(images) AS BIGINT) AS images, CAST(sum(failed) AS BIGINT) AS failed FROM r GROUP BY ROLLUP (d)",
}
