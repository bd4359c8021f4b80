"""Structural telemetry: images inside forms, inline images, luminosity masks, what could not be inspected.

The walk of forms within forms goes by document, since it follows resources through an active set; what it finds are rows,
and the sums are aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content
from ..functions.pdf import Document, PdfError, Ref, Stream, read

#: Depth of forms and operators of a document.
FORM_DEPTH, OPERATORS = 64, 1_000_000
FOUND = "doc_id long, kind string, page_no int, num int, depth int, bytes long"


class _Walk:
    def __init__(self, doc: Document):
        self.doc, self.rows, self.left = doc, [], OPERATORS

    def run(self) -> list[tuple]:
        for i, page in enumerate(content.pages(self.doc)):
            self.body(content.content_bytes(self.doc, page), self.doc.dict_of(page.inherited.get("Resources")), i, 0, frozenset())
        return self.rows

    def add(self, kind: str, page: int, num: int = 0, depth: int = 0, size: int = 0) -> None:
        self.rows.append((kind, page, num, depth, size))

    def body(self, data: bytes, resources: dict, page: int, depth: int, active: frozenset) -> None:
        for op in content.operations(data):
            self.left -= 1
            if self.left < 0:
                self.add("uninspectable", page)
                return
            if op.operator == "BI":
                self.add("inline", page, depth=depth, size=len(op.operands[1]))
            elif op.operator == "Do" and op.operands:
                self.painted(self.doc.dict_of(resources.get("XObject")).get(str(op.operands[0])), resources, page, depth, active)
            elif op.operator == "gs" and op.operands:
                mask = self.doc.dict_of(self.doc.dict_of(self.doc.dict_of(resources.get("ExtGState")).get(str(op.operands[0]))).get("SMask"))
                if mask.get("S") == "Luminosity":
                    self.add("luminosity_mask", page)
                if "G" in mask:
                    self.form(mask["G"], resources, page, depth, active)

    def painted(self, ref: object, resources: dict, page: int, depth: int, active: frozenset) -> None:
        v = self.doc.get(ref)
        if not isinstance(v, Stream):
            self.add("uninspectable", page)
        elif v.dict.get("Subtype") == "Image":
            self.add("form_image" if depth else "page_image", page, ref.num if isinstance(ref, Ref) else 0, depth, len(v.raw))
        elif v.dict.get("Subtype") == "Form":
            self.form(ref, resources, page, depth, active)

    def form(self, ref: object, resources: dict, page: int, depth: int, active: frozenset) -> None:
        v = self.doc.get(ref)
        if ref in active or depth >= FORM_DEPTH or not isinstance(v, Stream):
            self.add("uninspectable", page)
            return
        data = self.doc.decoded(v)
        if data is None:
            self.add("uninspectable", page)
            return
        self.add("form", page, ref.num if isinstance(ref, Ref) else 0, depth + 1)
        self.body(data, self.doc.dict_of(v.dict.get("Resources")) or resources, page, depth + 1, active | {ref})


def walked(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(d, *r) for r in _Walk(read(data.as_py())).run()] + [(d, "document", 0, 0, 0, 0)]
                except (PdfError, RecursionError, ValueError, TypeError):
                    rows = [(d, "unreadable", 0, 0, 0, 0)]
                names = FOUND.replace(",", "").split()[::2]
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("doc_id", "content").mapInArrow(run, FOUND)


def telemetry(files: DataFrame) -> DataFrame:
    """One row per file. Images of forms count where no page paints them itself."""
    from ..plans.iterate import checkpoint

    rows = checkpoint(walked(files))
    own = rows.where("kind = 'page_image'").select("doc_id", "num").distinct()
    inside = rows.where("kind = 'form_image'").join(own, ["doc_id", "num"], "left_anti")
    only = inside.groupBy("doc_id", "num").agg(F.max("bytes").alias("bytes")).groupBy("doc_id").agg(F.count("*").alias("form_only_images"), F.sum("bytes").alias("form_only_bytes"))
    kind = lambda k: F.col("kind") == k
    sums = rows.groupBy("doc_id").agg(
        F.bool_or(kind("unreadable")).alias("unreadable"),
        F.count_if(kind("inline")).alias("inline_images"),
        F.coalesce(F.sum(F.when(kind("inline"), F.col("bytes"))), F.lit(0)).alias("inline_bytes"),
        F.coalesce(F.max(F.when(kind("form"), F.col("depth"))), F.lit(0)).alias("form_depth"),
        F.count_distinct(F.when(kind("form"), F.col("page_no"))).alias("pages_with_forms"),
        F.count_if(kind("luminosity_mask")).alias("luminosity_masks"),
        F.count_if(kind("uninspectable")).alias("uninspectable"),
    )
    return sums.join(only, "doc_id", "left").fillna(0, ["form_only_images", "form_only_bytes"])
