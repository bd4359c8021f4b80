"""Edits of files: regional text removal, text replacement and page arrangement, set-oriented over a table of files.

Requests are tables keyed by doc_id, which meet the files in one equi join, as one array per file; or the files bring them
along in such a column (requests: None), and then no file's bytes are shuffled. Each file is edited in one Arrow pass, because
its steps are sequential by nature. A file that cannot be edited keeps its bytes and says why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrange, edit
from ..options import EditOptions
from ..sources.made import Made, over

#: Bytes of an edited file that close a batch of results; smaller ones go in batches of 32.
ALONE = 1 << 20
_REGIONS = "id string, page int, status string, removed_glyphs int"
_RISKS = "array<struct<kind:string,page:int,detail:string>>"
_GAPS = "array<struct<reason:string,page:int,detail:string>>"
REMOVED = f"doc_id long, content binary, modified boolean, error string, regions array<struct<id:string,page:int,status:string,removed_glyphs:int>>, residual_risks {_RISKS}, inspection_gaps {_GAPS}, sig_flags boolean, sig_field boolean, perms boolean"
REPLACED = f"doc_id long, content binary, modified boolean, error string, replacements array<struct<id:string,page:int,status:string,replaced_glyphs:int,original_text:string,new_text:string,original_advance:double,new_advance:double,scanned_pages:array<int>,scan_incomplete:boolean>>, residual_risks {_RISKS}, inspection_gaps {_GAPS}, sig_flags boolean, sig_field boolean, perms boolean"
ARRANGED = "doc_id long, content binary, error string, pages_in int, pages_out int, outline_items_removed int, links_removed int, named_dests_removed int, fields_removed int, references_cleared int, page_labels_dropped boolean, structure_dropped boolean, was_signed boolean"


def _each(files: DataFrame | Made, requests: DataFrame | None, name: str, order: list[str], schema: str, edit_one: Callable[[bytes, list[dict]], dict]) -> DataFrame:
    if requests is None:
        both = files.where(F.size(name) > 0)
    else:
        items = requests.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order))).alias(name))
        both = files.select("doc_id", "content").join(items, "doc_id")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict[str, Any]] = []
        for batch in batches:
            for d, data, items in zip(*batch.columns, strict=True):
                rows.append({"doc_id": d.as_py()} | edit_one(data.as_py(), items.as_py()))
                if len(rows) >= 32 or len(rows[-1]["content"] or b"") > ALONE:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return over(both, ["doc_id", "content", name], run, schema)


def remove_text(files: DataFrame | Made, regions: DataFrame | None, options: EditOptions = EditOptions()) -> DataFrame:
    """regions: doc_id, ord, id, page, x, y, width, height. One row per file that has any. None: in the column `regions`, by ord."""
    return _each(files, regions, "regions", ["ord", "id", "page", "x", "y", "width", "height"], REMOVED, lambda data, rows: edit.remove(data, rows, options))


def replace_text(files: DataFrame | Made, replacements: DataFrame | None, options: EditOptions = EditOptions()) -> DataFrame:
    """replacements: doc_id, ord, id, page, x, y, width, height, text. Later ones see the result of earlier ones. None: in the column `replacements`."""
    return _each(files, replacements, "replacements", ["ord", "id", "page", "x", "y", "width", "height", "text"], REPLACED, lambda data, rows: edit.replace(data, rows, options))


def arrange_pages(files: DataFrame | Made, plan: DataFrame | None, options: EditOptions = EditOptions()) -> DataFrame:
    """plan: doc_id, ord, source (page, 0-based), rotate (0, 90, 180 or 270). The pages of each file in this order. None: in the column `plan`."""
    return _each(files, plan, "plan", ["ord", "source", "rotate"], ARRANGED, lambda data, rows: arrange.arrange(data, [(r["source"], r["rotate"]) for r in rows], options))


def exit_code(result: DataFrame) -> DataFrame:
    """0 if all is guaranteed, 2 if the file was written without a guarantee, with the reasons."""
    unclean = F.exists("regions", lambda r: ~r["status"].isin("removed", "nothing_found"))
    signature = F.col("modified") & (F.col("sig_flags") | F.col("sig_field") | F.col("perms"))
    why = F.array_compact(F.array(
        F.when(unclean, F.lit("region_not_clean")),
        F.when(F.size("residual_risks") > 0, F.lit("residual_risk")),
        F.when(F.size("inspection_gaps") > 0, F.lit("inspection_incomplete")),
        F.when(signature, F.lit("signature_invalidated")),
    ))
    return result.withColumn("reasons", why).withColumn("exit_code", F.when(F.col("error").isNotNull(), 1).when(F.size(why) > 0, 2).otherwise(0))
