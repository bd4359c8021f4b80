"""PDF files made from the rows of `documents`, by closed formulas, so that SQL over the rows tells what a query over the
files must find. The structure is described by `describe`."""

from __future__ import annotations

import zlib
from functools import lru_cache
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

from ..functions.pdf import Document, Name, Ref, Stream, write_classic
from .made import Made

LINE, LINES, WIDE, HIGH = 80, 50, 612, 792
FONT = {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("Plain"), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 0, "LastChar": 255, "Widths": [500] * 256}
FILES = "doc_id long, path string, length long, content binary"


def describe() -> dict[str, str]:
    """Property of a file: formula over the row (d = doc_id, t = text with line ends as spaces, n = its length)."""
    return {
        "lines": "greatest(1, ceil(n / 80))",
        "pages": "greatest(1, ceil(lines / 50))",
        "rotation": "90 * (d % 4), set on the root of the page tree",
        "signed": "d % 11 = 0: the first page has /ByteRange",
        "encrypted": "d % 97 = 96: the trailer has /Encrypt",
        "images": "d % 4 on the first page, side 100 + 50 * (d % 7) px in a box of 144 pt",
        "image kind": "(d + j % 2) % 5: raw RGB, raw gray, JPX, CCITT, 4 bits a component",
        "image pixels": "seed j % 2",
        "orphans": "d % 3 dictionaries that nothing refers to",
        "outline": "an item for each page; a link on each page to the next",
    }


def flat(text: str | None) -> str:
    return (text or "").replace("\r", " ").replace("\n", " ")


def pixels(side: int, channels: int, seed: int) -> bytes:
    """A smooth pattern that differs by seed."""
    y, x = np.mgrid[0:side, 0:side]
    planes = [(x * (3 + seed) + y * (5 + k)) % 256 for k in range(channels)]
    return np.stack(planes, axis=-1).astype(np.uint8).tobytes()


def image(d: int, j: int) -> Stream:
    return _image(d % 35, j)


@lru_cache(maxsize=256)  # 105 of them, 3 MB in all
def _image(d: int, j: int) -> Stream:
    side, kind = 100 + 50 * (d % 7), (d + j % 2) % 5
    values = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": side, "Height": side, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB"), "Name": Name(f"I{j}")}
    if kind in (2, 3):  # not decodable here: the bytes only tell seeds apart
        values["Filter"] = Name("JPXDecode" if kind == 2 else "CCITTFaxDecode")
        return Stream(values, bytes([j % 2]) * 1000)
    if kind == 1:
        values["ColorSpace"] = Name("DeviceGray")
    if kind == 4:
        values |= {"BitsPerComponent": 4, "ColorSpace": Name("DeviceGray")}
        return Stream(values | {"Filter": Name("FlateDecode")}, zlib.compress(pixels(side, 1, j % 2)[: (side + 1) // 2 * side]))
    return Stream(values | {"Filter": Name("FlateDecode")}, zlib.compress(pixels(side, 3 if kind == 0 else 1, j % 2), 1))


def stream_lengths() -> dict[tuple[int, int, int], int]:
    """Bytes of an image's stream by kind, side and seed."""
    made = {(d, j): image(d, j) for d in range(35) for j in range(2)}
    return {((d + j) % 5, 100 + 50 * (d % 7), j): len(v.raw) for (d, j), v in made.items()}


def build(d: int, text: str | None) -> bytes:
    t = flat(text)
    lines = [t[i : i + LINE] for i in range(0, max(1, len(t)), LINE)]
    chunks = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
    objects: dict[Ref, object] = {}

    def put(value: object) -> Ref:
        ref = Ref(len(objects) + 1, 0)
        objects[ref] = value
        return ref

    catalog, tree, outlines = put(None), put(None), put(None)
    font = put(FONT)
    images = [put(image(d, j)) for j in range(d % 4)]
    refs = [put(None) for _ in chunks]
    for i, (ref, chunk) in enumerate(zip(refs, chunks, strict=True)):
        parts = [b"q 144 0 0 144 %d 560 cm /I%d Do Q" % (40 + 150 * j, j) for j in range(len(images))] if i == 0 else []
        parts.append(b"BT /F1 10 Tf 14 TL 50 740 Td")
        for k, line in enumerate(chunk):
            body = line.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            parts.append((b"T* " if k else b"") + b"(" + body + b") Tj")
        parts.append(b"ET")
        stream = put(Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"\n".join(parts), 1)))
        page = {"Type": Name("Page"), "Parent": tree, "Contents": stream}
        if i == 0 and images:
            page["Resources"] = {"Font": {"F1": font}, "XObject": {f"I{j}": r for j, r in enumerate(images)}}
        if i == 0 and d % 11 == 0:
            page["ByteRange"] = [0, 0, 0, 0]
        if i + 1 < len(refs):
            page["Annots"] = [put({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [300, 700, 400, 720], "Dest": [refs[i + 1], Name("Fit")]})]
        objects[ref] = page
    items = [put(None) for _ in refs]
    for i, item in enumerate(items):
        own = {"Title": b"Page %d" % (i + 1), "Parent": outlines, "Dest": [refs[i], Name("Fit")]}
        own |= {"Prev": items[i - 1]} if i else {}
        own |= {"Next": items[i + 1]} if i + 1 < len(items) else {}
        objects[item] = own
    objects[outlines] = {"Type": Name("Outlines"), "First": items[0], "Last": items[-1], "Count": len(items)}
    objects[tree] = {"Type": Name("Pages"), "Kids": refs, "Count": len(refs), "MediaBox": [0, 0, WIDE, HIGH], "Rotate": 90 * (d % 4), "Resources": {"Font": {"F1": font}}}
    objects[catalog] = {"Type": Name("Catalog"), "Pages": tree, "Outlines": outlines}
    for k in range(d % 3):
        put({"Orphan": k})
    trailer = {"Root": catalog} | ({"Encrypt": {"Filter": Name("Standard"), "V": 1}} if d % 97 == 96 else {})
    return write_classic(Document(objects, trailer, "1.4"))


def made(documents: DataFrame, *carried: str, dealt: bool = False) -> Made:
    """doc_id, path, length and content of the file made from each row, and what else of the row is carried along. Rows
    without a doc_id are left out. dealt: the rows lie in even parts already."""
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", "text", *carried)
    schema = _parse_datatype_string(FILES)
    for name in carried:
        schema.add(rows.schema[name])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids = part.column(0).to_pylist()
                out = [build(d, t) for d, t in zip(ids, part.column(1).to_pylist(), strict=True)]
                own = [pa.array(ids, pa.int64()), pa.array([f"doc-{d}.pdf" for d in ids], pa.string()), pa.array(map(len, out), pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(own + part.columns[2:], names=names)

    return Made(rows if dealt else rows.repartition(tasks(documents)), run, schema)


def tasks(documents: DataFrame) -> int:
    """Tasks to deal rows out to: a scan of few row groups keeps few cores busy, however many splits it has, and building is work."""
    return max(4 * documents.sparkSession.sparkContext.defaultParallelism, documents.rdd.getNumPartitions())


def files(documents: DataFrame) -> DataFrame:
    return made(documents).frame()
