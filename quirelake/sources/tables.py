"""From files to tables: one parse of each file yields nested arrays, which explode into relational tables.

A file that cannot be read is a row with a status, never a failed job. Only the sections asked for are computed; filter and
select before `facts`, since nothing moves below a Python map.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import content, geometry
from ..functions.pdf import Document, Encrypted, Hex, Name, PdfError, Ref, Stream, read, references, shown
from .made import Made, over

#: Section -> type of its rows.
SECTIONS = {
    "objects": "num int, gen int, kind string, type string, subtype string, stream_len long, content_sha string, dict_key string, is_plain_flate boolean, has_byte_range boolean, value string",
    "refs": "src_num int, src_gen int, path array<string>, dst_num int, dst_gen int",
    "pages": "page_no int, num int, gen int, media_box array<double>, crop_box array<double>, rotate double, user_unit double, content_ids array<int>",
    "resources": "page_no int, category string, name string, depth int, num int, gen int",
    "placements": "page_no int, op_index int, name string, a float, b float, c float, d float, e float, f float",
    "ops": "page_no int, op_index int, operator string, operands array<string>",
    "page_text": "page_no int, text_bytes long, operators long, inline_images long, inline_bytes long, inline_color long",
    "images": "num int, gen int, width long, height long, bits int, filters array<string>, color_space string, channels int, hival int, palette_bytes long, is_mask boolean, smask string, has_matte boolean, decode array<double>, has_color_key boolean, stream_len long, content_sha string, render_key string, has_predictor boolean, image_key string",
    "annotations": "page_no int, position int, subtype string, rect array<double>, dest_page int, is_signature boolean",
    "outline": "position int, dest_page int",
    "soft_masks": "src_num int, src_gen int, path array<string>, dst_num int, dst_gen int",
}
_HEAD = "doc_id long, status string, error string, length long, page_count int, object_count int, sig_flags boolean, sig_nonzero boolean, sig_field boolean, perms boolean, form_images array<int>, mask_images array<int>"

#: Keys that do not change what an image shows.
NOT_RENDERED = ("Length", "Type", "Name", "Metadata", "PieceInfo", "LastModified")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: doc_id (a hash of the path), path, length, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def facts(files: DataFrame | Made, *sections: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per file: status, counts and signature marks, an array for each section, and the columns of `keep` as they were.

    A section is named alone or with the columns that are wanted, as in "objects(kind, type)"; only those are worked out.
    """
    wanted = dict(map(_wanted, sections))
    schema: StructType = _parse_datatype_string(_HEAD + "".join(f", {s} array<struct<{_colons(', '.join(cs.values()))}>>" for s, cs in wanted.items()))
    from pyspark.sql.pandas.types import to_arrow_schema

    own = to_arrow_schema(schema)
    for name in keep:
        schema.add(files.schema[name])
    names = schema.names
    columns = {s: frozenset(cs) for s, cs in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 32):
                part = batch.slice(start, 32)
                rows = [_row(d, n, c.as_py(), columns) for d, n, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays(pa.RecordBatch.from_pylist(rows, own).columns + part.columns[3:], names=names)

    return over(files, ["doc_id", "length", "content", *keep], run, schema)


def _wanted(spec: str) -> tuple[str, dict[str, str]]:
    """Section and its wanted columns with their types."""
    name, _, columns = spec.removesuffix(")").partition("(")
    every = {f.strip().split(" ", 1)[0]: f.strip() for f in SECTIONS[name].split(",")}
    return name, {c: every[c] for c in (x.strip() for x in columns.split(","))} if columns else every


def _colons(fields: str) -> str:
    return _parse_datatype_string(fields).simpleString().removeprefix("struct<").removesuffix(">")


def section(found: DataFrame, name: str) -> DataFrame:
    """A section as a table keyed by doc_id."""
    return found.where("status = 'ok'").select("doc_id", F.explode(name).alias("_r")).select("doc_id", "_r.*")


def _row(doc_id: int, length: int, data: bytes | None, sections: dict[str, frozenset]) -> dict:
    row: dict[str, Any] = {"doc_id": doc_id, "length": length, "status": "ok", "error": None}
    try:
        doc = read(data or b"")
        found = _Facts(doc, sections)
        own = {s: getattr(found, s)() for s in sections}
        return row | {"page_count": len(found.leaves), "object_count": len(doc.objects)} | found.signature() | {"form_images": found.form_images() if "images" in sections else None, "mask_images": found.mask_images() if "images" in sections else None} | own
    except Encrypted:
        return row | {"status": "encrypted", "error": "the file is encrypted"}
    except (PdfError, RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError, AttributeError) as e:
        return row | {"status": "parse_error", "error": f"{type(e).__name__}: {e}"[:200]}


def canonical(doc: Document, value: Any, depth: int = 16) -> bytes:
    """A value with references resolved and keys in order; beyond the depth, and for what is missing, a mark that never
    equals another value's."""
    if depth < 0:
        return b"!deep" + repr(value).encode()
    if isinstance(value, Ref):
        own = doc.objects.get(value)
        return b"!ref%d" % value.num if own is None else canonical(doc, own, depth - 1)
    if isinstance(value, Stream):
        return b"stream" + canonical(doc, value.dict, depth - 1) + hashlib.sha256(value.raw).digest()
    if isinstance(value, dict):
        return b"<<" + b" ".join(shown(Name(k)) + b" " + canonical(doc, v, depth - 1) for k, v in sorted(value.items())) + b">>"
    if isinstance(value, list):
        return b"[" + b" ".join(canonical(doc, v, depth - 1) for v in value) + b"]"
    return shown(value)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


class _Facts:
    """What one document holds, section by section."""

    def __init__(self, doc: Document, wanted: dict[str, frozenset] | None = None):
        self.doc, self.wanted = doc, wanted or {}
        self.leaves = content.pages(doc)
        self._ops: dict[int, list] = {}
        self._places = {p.ref: i for i, p in enumerate(self.leaves)}

    def wants(self, section: str, column: str) -> bool:
        return section not in self.wanted or column in self.wanted[section]

    def page_ops(self, i: int) -> list:
        if i not in self._ops:
            self._ops[i] = content.operations(content.content_bytes(self.doc, self.leaves[i]))
        return self._ops[i]

    def box(self, value: Any) -> list[float] | None:
        value = [self.doc.get(x) for x in v] if isinstance(v := self.doc.get(value), list) else None
        return [float(x) for x in value] if value and len(value) == 4 and all(map(_number, value)) else None

    def signature(self) -> dict:
        form = self.doc.dict_of(self.doc.catalog.get("AcroForm"))
        flags = self.doc.get(form.get("SigFlags"))
        flags = flags if isinstance(flags, int) and not isinstance(flags, bool) else 0
        todo, seen, field = list(self.doc.get(form.get("Fields")) or []), set(), False
        while todo and not field:
            ref = todo.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            own = self.doc.dict_of(ref)
            field = self.doc.get(own.get("FT")) == "Sig"
            todo += self.doc.get(own.get("Kids")) or []
        return {"sig_flags": bool(flags & 1), "sig_nonzero": flags != 0, "sig_field": field, "perms": "Perms" in self.doc.catalog}

    def objects(self) -> list[dict]:
        out = []
        sha, key_, shown_ = (self.wants("objects", c) for c in ("content_sha", "dict_key", "value"))
        for ref, v in sorted(self.doc.objects.items()):
            d = v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}
            kind = "stream" if isinstance(v, Stream) else "dict" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "scalar"
            text = lambda k: str(x) if isinstance(x := self.doc.get(d.get(k)), Name) else None  # noqa: E731, B023
            out.append({"num": ref.num, "gen": ref.gen, "kind": kind, "type": text("Type"), "subtype": text("Subtype"), "stream_len": len(v.raw) if isinstance(v, Stream) else None, "content_sha": _sha(v.raw) if sha and isinstance(v, Stream) else None, "dict_key": _sha(shown({k: x for k, x in d.items() if k != "Length"})) if key_ and isinstance(v, Stream) else None, "is_plain_flate": isinstance(v, Stream) and d.get("Filter") in ("FlateDecode", ["FlateDecode"]) and "DecodeParms" not in d, "has_byte_range": isinstance(v, dict) and "ByteRange" in d, "value": shown(d if isinstance(v, Stream) else v).decode("latin-1") if shown_ else None})
        return out

    def refs(self) -> list[dict]:
        rows = [(0, 0, self.doc.trailer), *((r.num, r.gen, v) for r, v in sorted(self.doc.objects.items()))]
        return [{"src_num": n, "src_gen": g, "path": list(p), "dst_num": t.num, "dst_gen": t.gen} for n, g, v in rows for p, t in references(v)]

    def soft_masks(self) -> list[dict]:
        """The references of `refs` by which images name their /SMask."""
        return [{"src_num": r.num, "src_gen": r.gen, "path": ["SMask"], "dst_num": t.num, "dst_gen": t.gen} for r, v in sorted(self.doc.objects.items()) if isinstance(v, Stream) and v.dict.get("Subtype") == "Image" and isinstance(t := v.dict.get("SMask"), Ref)]

    def pages(self) -> list[dict]:
        out = []
        for i, p in enumerate(self.leaves):
            rotate, unit = self.doc.get(p.inherited.get("Rotate")), self.doc.get(p.dict.get("UserUnit"))
            out.append({"page_no": i, "num": p.ref.num, "gen": p.ref.gen, "media_box": self.box(p.inherited.get("MediaBox")), "crop_box": self.box(p.inherited.get("CropBox")), "rotate": float(rotate) if _number(rotate) else 0.0, "user_unit": float(unit) if _number(unit) else 1.0, "content_ids": [r.num for r in content.content_refs(self.doc, p)]})
        return out

    def resources(self) -> list[dict]:
        """Names of each page's own resources (depth 0), else of those inherited."""
        out = []
        for i, p in enumerate(self.leaves):
            depth, node, seen = 0, p.dict, set()
            while node and depth <= content.TREE_LEVELS:
                for category, names in self.doc.dict_of(node.get("Resources")).items():
                    for name, target in self.doc.dict_of(names).items():
                        if isinstance(target, Ref):
                            out.append({"page_no": i, "category": category, "name": name, "depth": depth, "num": target.num, "gen": target.gen})
                parent = node.get("Parent")
                if parent in seen or not isinstance(parent, Ref):
                    break
                seen.add(parent)
                node, depth = self.doc.dict_of(parent), depth + 1
        return out

    def placements(self) -> list[dict]:
        painting = [i for i, page in enumerate(self.leaves) if i in self._ops or b"Do" in content.content_bytes(self.doc, page)]
        return [{"page_no": i, "op_index": p.op_index, "name": p.name} | {k: float(x) for k, x in zip("abcdef", p.ctm, strict=True)} for i in painting for p in geometry.placements(self.page_ops(i))]

    def ops(self) -> list[dict]:
        text = lambda x: shown(x if not isinstance(x, bytes) or isinstance(x, Hex) else bytes(x)).decode("latin-1")
        return [{"page_no": i, "op_index": k, "operator": o.operator, "operands": [text(x) for x in o.operands]} for i in range(len(self.leaves)) for k, o in enumerate(self.page_ops(i))]

    def page_text(self) -> list[dict]:
        out = []
        for i in range(len(self.leaves)):
            ops = self.page_ops(i)
            inline = [o.operands for o in ops if o.operator == "BI"]
            out.append({"page_no": i, "text_bytes": content.shown_text_bytes(ops), "operators": len(ops), "inline_images": len(inline), "inline_bytes": sum(len(b) for _, b in inline), "inline_color": sum(content.is_color_inline(v) for v, _ in inline)})
        return out

    def images(self) -> list[dict]:
        return [self._image(r, v) for r, v in sorted(self.doc.objects.items()) if isinstance(v, Stream) and v.dict.get("Subtype") == "Image"]

    def _image(self, ref: Ref, v: Stream) -> dict:
        whole = lambda k: x if isinstance(x := self.doc.get(v.dict.get(k)), int) and not isinstance(x, bool) else None
        names, parms = self.doc.filters(v)
        space, channels, hival, palette = self._space(v.dict.get("ColorSpace"))
        mask = v.dict.get("SMask")
        smask = self.doc.get(mask)
        kind = None if mask is None or smask == "None" else "stream" if isinstance(mask, Ref) and isinstance(smask, Stream) else "unresolved" if isinstance(mask, Ref) else "direct"
        decode = self.doc.get(v.dict.get("Decode"))
        decode = [float(x) for x in decode] if isinstance(decode, list) and all(map(_number, decode)) else None
        sha = _sha(v.raw) if self.wants("images", "content_sha") else None
        render = _sha(canonical(self.doc, {k: x for k, x in v.dict.items() if k not in NOT_RENDERED})) if self.wants("images", "render_key") else None
        return {"num": ref.num, "gen": ref.gen, "width": whole("Width"), "height": whole("Height"), "bits": whole("BitsPerComponent"), "filters": names, "color_space": space, "channels": channels, "hival": hival, "palette_bytes": palette, "is_mask": self.doc.get(v.dict.get("ImageMask")) is True, "smask": kind, "has_matte": kind == "stream" and "Matte" in smask.dict, "decode": decode, "has_color_key": isinstance(self.doc.get(v.dict.get("Mask")), list), "stream_len": len(v.raw), "content_sha": sha, "render_key": render, "has_predictor": any(p.get("Predictor", 1) != 1 for p in parms), "image_key": f"{ref.num} {ref.gen}"}

    def _space(self, value: Any) -> tuple[str | None, int | None, int | None, int | None]:
        """Family, components, and for Indexed the highest index and the palette's bytes."""
        value = self.doc.get(value)
        device = {"DeviceRGB": 3, "DeviceGray": 1, "DeviceCMYK": 4, "RGB": 3, "G": 1, "CMYK": 4}
        if isinstance(value, Name):
            return str(value), device.get(value), None, None
        if isinstance(value, list) and value:
            family = str(self.doc.get(value[0]))
            if family == "ICCBased" and len(value) > 1:
                n = self.doc.get(self.doc.dict_of(value[1]).get("N"))
                return family, n if n in (1, 3, 4) else None, None, None
            if family == "Indexed" and len(value) == 4:
                table, base = self.doc.get(value[3]), self._space(value[1])
                table = self.doc.decoded(table) if isinstance(table, Stream) else table
                return f"Indexed/{base[0]}", base[1], self.doc.get(value[2]), len(table) if isinstance(table, bytes) else None
            return family, None, None, None
        return None, None, None, None

    def form_images(self) -> list[int]:
        """Images that signature appearances paint, through at most three levels of forms."""
        out: set[int] = set()

        def form(ref: Any, depth: int) -> None:
            own = self.doc.dict_of(ref)
            if depth > 3 or own.get("Subtype") != "Form":
                return
            for target in self.doc.dict_of(self.doc.dict_of(own.get("Resources")).get("XObject")).values():
                sub = self.doc.dict_of(target).get("Subtype")
                if sub == "Image" and isinstance(target, Ref):
                    out.add(target.num)
                elif sub == "Form":
                    form(target, depth + 1)

        for page in self.leaves:
            for annot in self.doc.get(page.dict.get("Annots")) or []:
                own = self.doc.dict_of(annot)
                if self.is_signature(own):
                    normal = self.doc.dict_of(own.get("AP")).get("N")
                    states = [normal] if isinstance(self.doc.get(normal), Stream) else list(self.doc.dict_of(normal).values())
                    for state in states:
                        form(state, 1)
        return sorted(out)

    def mask_images(self) -> list[int]:
        """Images that the groups of soft masks paint, through at most 32 levels of forms."""
        out: set[int] = set()
        seen: set[tuple[Any, bool]] = set()

        def walk(resources: Any, inside: bool, depth: int) -> None:
            own = self.doc.dict_of(resources)
            for state in self.doc.dict_of(own.get("ExtGState")).values():
                group = self.doc.dict_of(self.doc.dict_of(state).get("SMask")).get("G")
                if group is not None:
                    form(group, True, depth + 1)
            for target in self.doc.dict_of(own.get("XObject")).values():
                kind = self.doc.dict_of(target).get("Subtype")
                if kind == "Image" and inside and isinstance(target, Ref):
                    out.add(target.num)
                elif kind == "Form":
                    form(target, inside, depth + 1)

        def form(ref: Any, inside: bool, depth: int) -> None:
            if depth <= 32 and isinstance(ref, Ref) and (ref, inside) not in seen:
                seen.add((ref, inside))
                walk(self.doc.dict_of(ref).get("Resources"), inside, depth)

        for page in self.leaves:
            walk(page.inherited.get("Resources"), False, 0)
        return sorted(out)

    def is_signature(self, annot: dict) -> bool:
        """A widget whose field type, its own or of up to eight parents, is Sig."""
        if annot.get("Subtype") != "Widget":
            return False
        for _ in range(9):
            kind = self.doc.get(annot.get("FT"))
            if kind is not None:
                return kind == "Sig"
            annot = self.doc.dict_of(annot.get("Parent"))
        return False

    def _page_of(self, dest: Any) -> int | None:
        dest = self.doc.get(dest)
        dest = self.doc.get(dest.get("D")) if isinstance(dest, dict) else dest
        return self._places.get(dest[0]) if isinstance(dest, list) and dest and isinstance(dest[0], Ref) else None

    def annotations(self) -> list[dict]:
        out = []
        for i, page in enumerate(self.leaves):
            for k, annot in enumerate(self.doc.get(page.dict.get("Annots")) or []):
                own = self.doc.dict_of(annot)
                action = self.doc.dict_of(own.get("A"))
                dest = own.get("Dest", action.get("D") if action.get("S") == "GoTo" else None)
                sub = self.doc.get(own.get("Subtype"))
                out.append({"page_no": i, "position": k, "subtype": str(sub) if sub else None, "rect": self.box(own.get("Rect")), "dest_page": self._page_of(dest), "is_signature": self.is_signature(own)})
        return out

    def outline(self) -> list[dict]:
        out, seen = [], set()
        todo = [self.doc.dict_of(self.doc.catalog.get("Outlines")).get("First")]
        while todo and len(seen) < 1_000_000:
            ref = todo.pop()
            if not isinstance(ref, Ref) or ref in seen:
                continue
            seen.add(ref)
            own = self.doc.dict_of(ref)
            action = self.doc.dict_of(own.get("A"))
            out.append({"position": len(out), "dest_page": self._page_of(own.get("Dest", action.get("D") if action.get("S") == "GoTo" else None))})
            todo += [own.get("Next"), own.get("First")]
        return out
