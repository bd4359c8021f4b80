"""One file's rewrite: pixels of the images that the plan names, flattened signatures, cleaned streams, bytes."""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from typing import Any, NamedTuple

import numpy as np

from ..options import CompressOptions
from . import arrange, colour, content, filters, fonts, geometry, jpeg
from .pdf import Document, Name, Ref, Stream, read, references, shown, write_packed

#: Bounds of what another zlib pass is tried on.
REFLATE_LEAST, REFLATE_MOST = 51_200, 268_435_456
PRODUCER = "quirelake"


def decoded_image(doc: Document, v: Stream) -> np.ndarray | None:
    """Gray or RGB samples of an image that the plan calls decodable; None if its data is broken."""
    names, parms = doc.filters(v)
    names = [filters.SHORT_NAMES.get(n, n) for n in names]
    if names and names[-1] == "DCTDecode":
        body = filters.decode(v.raw, names[:-1], parms[:-1])
        img = jpeg.decode(body) if body is not None else None
        return colour.from_cmyk(img, adobe=True) if img is not None and img.ndim == 3 and img.shape[-1] == 4 else img
    body = filters.decode(v.raw, names, parms)
    if body is None:
        return None
    space = doc.get(v.dict.get("ColorSpace"))
    palette = None
    if isinstance(space, list) and doc.get(space[0]) == "Indexed":
        table = doc.get(space[3])
        table = doc.decoded(table) if isinstance(table, Stream) else table
        palette, space = (bytes(table or b""), doc.get(space[2])), doc.get(space[1])
    if isinstance(space, list) and doc.get(space[0]) == "ICCBased":
        channels = doc.get(doc.dict_of(space[1]).get("N"))
    else:
        channels = {"DeviceRGB": 3, "DeviceGray": 1, "DeviceCMYK": 4}.get(str(space))
    return colour.from_raw(body, doc.get(v.dict.get("Width")), doc.get(v.dict.get("Height")), channels, palette) if channels else None


def encoded(img: np.ndarray, photo: bool, quality: int) -> tuple[bytes, str]:
    """(bytes, filter): JPEG for photos, lossless for line art."""
    if photo and (body := jpeg.encode(img, quality)) is not None:
        return body, "DCTDecode"
    return zlib.compress(np.ascontiguousarray(img).tobytes(), 9), "FlateDecode"


def reworked(doc: Document, v: Stream, plan: dict, options: CompressOptions) -> tuple[str, str | None, Stream | None, bool, int]:
    """(action, reason, new stream, turned gray, bytes that gray adds to colour) of one candidate. Not smaller means kept.

    Colour decides: what would not be written in colour does not turn gray either, and what would be written turns gray
    even where that takes more bytes.
    """
    key = _known_by(doc, v, plan, options)
    if key is None or (found := _recent.get(key)) is None:
        found = _encoded_anew(doc, v, plan)
        if key is not None:
            _recent.put(key, found)
    if found.body is None:
        return found.action, found.reason, None, False, 0
    drop = ("DecodeParms", "DP", "F", "Decode" if plan["decode"] == [0.0, 1.0] * (len(plan["decode"] or []) // 2) else "DP")
    values = {k: x for k, x in v.dict.items() if k not in drop}
    values |= {"Filter": Name(found.filter), "Width": found.width, "Height": found.height, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray" if found.flat else "DeviceRGB")}
    return found.action, None, Stream(values, found.body), found.gray, found.over


class Encoded(NamedTuple):
    """What an image's samples become. body: None if the image stays as it is. flat: gray samples."""

    action: str
    reason: str | None = None
    body: bytes | None = None
    filter: str = ""
    width: int = 0
    height: int = 0
    flat: bool = False
    gray: bool = False
    over: int = 0


class Recent:
    """The images encoded last in this worker, up to so many bytes: corpora repeat their pictures."""

    def __init__(self, most: int):
        self.most, self.held, self.kept = most, 0, OrderedDict()

    @staticmethod
    def weight(value: Encoded) -> int:
        return 512 + len(value.body or b"")

    def get(self, key: bytes) -> Encoded | None:
        if key in self.kept:
            self.kept.move_to_end(key)
        return self.kept.get(key)

    def put(self, key: bytes, value: Encoded) -> None:
        self.kept[key] = value
        self.held += self.weight(value)
        while self.held > self.most:
            self.held -= self.weight(self.kept.popitem(last=False)[1])


_recent = Recent(16 << 20)


def _known_by(doc: Document, v: Stream, plan: dict, options: CompressOptions) -> bytes | None:
    """A digest of all that `reworked` looks at: bytes, dictionary with what it refers to, plan, options. None if the
    dictionary leads to what is missing or too deep, which only the document tells apart."""
    from ..sources.tables import canonical

    values = canonical(doc, v.dict)
    if b"!ref" in values or b"!deep" in values:
        return None
    settings = repr([(k, x) for k, x in sorted(plan.items()) if k not in ("num", "gen")]) + repr(options)
    return hashlib.sha256(hashlib.sha256(v.raw).digest() + hashlib.sha256(values).digest() + settings.encode()).digest()


def _encoded_anew(doc: Document, v: Stream, plan: dict) -> Encoded:
    img = decoded_image(doc, v)
    if img is None:
        return Encoded("skipped", "decode_failed")
    if plan["is_soft_mask"] and img.ndim == 3:
        return Encoded("skipped", "non_gray_soft_mask")
    photo = not plan["lossless"] or colour.is_photo(img)
    first = "first_" if plan["lossless"] and photo else ""  # a lossless source that leaves as JPEG has settings of its own
    shrunk = plan[f"{first}downsample"]
    sized = lambda x: colour.resized(x, plan[f"{first}target_width"], plan[f"{first}target_height"]) if shrunk else x
    small = sized(img)
    body, name = encoded(small, photo, plan[f"{first}quality"])
    if len(body) >= len(v.raw):
        return Encoded("kept")
    over, gray = 0, plan["turns_gray"] and img.ndim == 3
    if gray:
        small = sized(colour.to_gray(img))
        in_colour = len(body)
        body, name = encoded(small, photo, plan[f"{first}quality"])
        over = max(0, len(body) - in_colour)
    return Encoded("downsampled" if shrunk else "recompressed", None, body, name, small.shape[1], small.shape[0], small.ndim == 2, gray, over)


def dedupe(doc: Document, key) -> int:
    """Point references to equal streams at the one of the lowest id; key tells which are equal (None: leave alone)."""
    first: dict[Any, Ref] = {}
    to: dict[Ref, Ref] = {}
    for ref, v in sorted(doc.objects.items()):
        if isinstance(v, Stream) and (k := key(ref, v)) is not None:
            if (old := first.setdefault(k, ref)) != ref:
                to[ref] = old
    if to:
        swap = lambda x: to.get(x, x) if isinstance(x, Ref) else Stream(swap(x.dict), x.raw) if isinstance(x, Stream) else {k: swap(v) for k, v in x.items()} if isinstance(x, dict) else [swap(v) for v in x] if isinstance(x, list) else x
        doc.objects = {r: swap(v) for r, v in doc.objects.items() if r not in to}
        doc.trailer = swap(doc.trailer)
    return len(to)


def reflated(doc: Document, cap: int) -> int:
    """Plain Flate streams once more at the best level, others without a filter for the first time; only if smaller.
    Returns how many were above the cap."""
    over = 0
    for ref, v in doc.objects.items():
        if not isinstance(v, Stream) or v.dict.get("Subtype") == "Image":
            continue
        names, _ = doc.filters(v)
        if names == ["FlateDecode"] and "DecodeParms" not in v.dict and len(v.raw) >= REFLATE_LEAST:
            body = filters.inflate(v.raw, cap)
            if body is None:
                over += 1
                continue
        elif not names and v.dict.get("Type") != "Metadata":
            body = v.raw
        else:
            continue
        small = zlib.compress(body, 9)
        if len(small) < len(v.raw):
            doc.objects[ref] = Stream(v.dict | {"Filter": Name("FlateDecode")}, small)
    return over


def flatten_signatures(doc: Document) -> int:
    """Paint each signature's appearance into its page, drop its widget, and drop the whole form."""
    from ..sources.tables import _Facts

    found, n = _Facts(doc), 0
    next_num = max((r.num for r in doc.objects), default=0) + 1
    for page in found.leaves:
        annots = doc.get(page.dict.get("Annots")) or []
        keep, paint, names = [], [], {}
        for annot in annots:
            own = doc.dict_of(annot)
            if not found.is_signature(own):
                keep.append(annot)
                continue
            n += 1
            normal = doc.dict_of(own.get("AP")).get("N")
            form = doc.get(normal)
            rect = found.box(own.get("Rect"))
            if isinstance(form, Stream) and isinstance(normal, Ref) and rect:
                matrix = doc.get(form.dict.get("Matrix")) or [1, 0, 0, 1, 0, 0]
                m = geometry.flatten_matrix(found.box(form.dict.get("BBox")) or rect, tuple(matrix), rect)
                name = f"Sig{n}"
                names[name] = normal
                paint.append(b"q " + b" ".join(shown(float(x)) for x in m) + b" cm /" + name.encode() + b" Do Q")
        if len(keep) < len(annots):
            page.dict["Annots"] = keep
        if paint:
            resources = dict(doc.dict_of(page.inherited.get("Resources")))
            resources["XObject"] = doc.dict_of(resources.get("XObject")) | names
            page.dict["Resources"] = resources
            head, tail = Ref(next_num, 0), Ref(next_num + 1, 0)
            next_num += 2
            doc.objects[head], doc.objects[tail] = Stream({}, b"q"), Stream({}, b"Q\n" + b"\n".join(paint))
            page.dict["Contents"] = [head, *content.content_refs(doc, page), tail]
    if n:
        doc.catalog.pop("AcroForm", None)
    return n


def strip(doc: Document) -> None:
    doc.trailer.pop("Info", None)
    doc.catalog.pop("Metadata", None)


def xmp(producer: str) -> bytes:
    return f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:pdf="http://ns.adobe.com/pdf/1.3/"><pdf:Producer>{producer}</pdf:Producer></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'.encode()


def brand(doc: Document) -> None:
    """Stamp the producer, after streams were compressed, so that the packet stays plain."""
    n = max((r.num for r in doc.objects), default=0) + 1
    doc.objects[Ref(n, 0)] = Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, xmp(PRODUCER))
    doc.catalog["Metadata"] = Ref(n, 0)


def compress(data: bytes, plan: list[dict], options: CompressOptions, is_signed: bool) -> dict:
    """Bytes and what was done. Strict leaves signed files alone; an output that is not smaller gives the input back."""
    stats = [{"num": p["num"], "action": p["action"], "skip_reason": p["skip_reason"], "input_bytes": p["stream_len"], "output_bytes": p["stream_len"]} for p in plan]
    out = {"content": data, "images": stats, "flattened": 0, "deduplicated": 0, "modified": False, "gray": 0, "gray_oversize": 0, "gray_unapplied": False, "fonts_subset": 0}
    if is_signed and options.signatures == "strict":
        return out | {"gray_unapplied": options.grayscale}
    doc = read(data)
    fonts_subset = fonts.subset_fonts(doc)["subset"] if options.subset_fonts else 0
    flattened = flatten_signatures(doc) if is_signed and options.signatures == "flatten" else 0
    gray = oversize = 0
    for p, s in zip(plan, stats, strict=True):
        ref = Ref(p["num"], p["gen"])
        v = doc.objects.get(ref)
        if p["action"] == "candidate" and isinstance(v, Stream):
            s["action"], s["skip_reason"], new, turned, over = reworked(doc, v, p, options)
            gray, oversize = gray + turned, oversize + (over > 0)
            if new is not None:
                doc.objects[ref] = new
                s["output_bytes"] = len(new.raw)
    if options.remove_metadata:
        strip(doc)
    same = 0
    if options.dedupe_images:
        from ..sources.tables import NOT_RENDERED, canonical

        left = {Ref(p["num"], p["gen"]) for p in plan if not p["is_soft_mask"] and p["action"] != "preserved" and p["smask"] is None}
        same = dedupe(doc, lambda r, v: (v.raw, canonical(doc, {k: x for k, x in v.dict.items() if k not in NOT_RENDERED})) if r in left else None)
    dedupe(doc, lambda _, v: (v.raw, shown({k: x for k, x in v.dict.items() if k != "Length"})))
    arrange.prune(doc)
    if options.recompress_streams:
        reflated(doc, options.max_stream_bytes or REFLATE_MOST)
    if options.remove_metadata:
        brand(doc)
    body = write_packed(doc)
    if len(body) > len(data) and (options.grayscale or not flattened):
        out |= {"gray_unapplied": options.grayscale}
        return out | {"images": [s | {"action": "kept" if s["action"] in ("recompressed", "downsampled") else s["action"], "output_bytes": s["input_bytes"]} for s in stats]}
    return out | {"content": body, "flattened": flattened, "deduplicated": same, "modified": True, "gray": gray, "gray_oversize": oversize, "fonts_subset": fonts_subset}
