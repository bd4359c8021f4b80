"""Which glyphs of embedded TrueType programs are drawn, and smaller programs that keep glyph numbers."""

from __future__ import annotations

import struct
import zlib
from typing import Any

from . import content
from .pdf import Document, Name, Ref, Stream

#: Tables that a program keeps.
KEPT_TABLES = ("OS/2", "cmap", "cvt ", "fpgm", "glyf", "head", "hhea", "hmtx", "loca", "maxp", "post", "prep")


def tables_of(data: bytes) -> dict[str, bytes] | None:
    """Tables by tag; None for what is not a whole TrueType program."""
    if len(data) < 12 or data[:4] not in (b"\0\1\0\0", b"true"):
        return None
    out = {}
    for i in range(struct.unpack(">H", data[4:6])[0]):
        row = data[12 + 16 * i : 28 + 16 * i]
        if len(row) < 16:
            return None
        tag, _, at, size = struct.unpack(">4sIII", row)
        if at + size > len(data):
            return None
        out[tag.decode("latin-1")] = data[at : at + size]
    return out


def components(glyph: bytes) -> list[int] | None:
    """Glyph numbers that a composite glyph is made of; none for a simple one, None if broken."""
    if len(glyph) < 10 or struct.unpack(">h", glyph[:2])[0] >= 0:
        return []
    at, out = 10, []
    while True:
        if at + 4 > len(glyph):
            return None
        flags, gid = struct.unpack(">HH", glyph[at : at + 4])
        out.append(gid)
        at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0)
        if not flags & 0x20:
            return out


def subset(data: bytes, used: set[int]) -> bytes | None:
    """The program with only the outlines of these glyphs, glyph 0, and what they are made of. None if it cannot be made."""
    own = tables_of(data)
    if own is None or not {"glyf", "loca", "head", "maxp", "hhea", "hmtx"} <= own.keys() or len(own["head"]) < 54:
        return None
    n, wide = struct.unpack(">H", own["maxp"][4:6])[0], struct.unpack(">h", own["head"][50:52])[0]
    if len(own["loca"]) < (n + 1) * (4 if wide else 2):
        return None
    loca = struct.unpack(f">{n + 1}{'I' if wide else 'H'}", own["loca"][: (n + 1) * (4 if wide else 2)])
    loca = loca if wide else [2 * x for x in loca]
    glyph = lambda g: own["glyf"][loca[g] : loca[g + 1]]
    keep, todo = set(), [0, *used]
    while todo:
        g = todo.pop()
        if g in keep or not 0 <= g < n:
            continue
        if loca[g + 1] < loca[g] or loca[g + 1] > len(own["glyf"]):
            return None
        keep.add(g)
        if (parts := components(glyph(g))) is None:
            return None
        todo += parts
    glyf, places = bytearray(), []
    for g in range(n):
        places.append(len(glyf))
        if g in keep:
            glyf += glyph(g)
            glyf += bytes(-len(glyf) % 4)
    places.append(len(glyf))
    new = {t: own[t] for t in KEPT_TABLES if t in own}
    new["glyf"], new["loca"] = bytes(glyf), struct.pack(f">{n + 1}I", *places)
    new["head"] = own["head"][:8] + bytes(4) + own["head"][12:50] + struct.pack(">h", 1) + own["head"][52:]
    new["post"] = struct.pack(">IIhhIIIII", 0x30000, *(struct.unpack(">Ihh", own["post"][4:12]) if len(own.get("post", b"")) >= 12 else (0, 0, 0)), 0, 0, 0, 0, 0)
    return assembled(new)


def _sum(data: bytes) -> int:
    data += bytes(-len(data) % 4)
    return sum(struct.unpack(f">{len(data) // 4}I", data)) & 0xFFFFFFFF


def assembled(tables: dict[str, bytes]) -> bytes:
    n = len(tables)
    power = 1 << (n.bit_length() - 1)
    head = struct.pack(">IHHHH", 0x10000, n, power * 16, power.bit_length() - 1, (n - power) * 16)
    at, rows, body = 12 + 16 * n, b"", b""
    for tag in sorted(tables):
        data = tables[tag]
        rows += struct.pack(">4sIII", tag.encode("latin-1"), _sum(data), at + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    out = bytearray(head + rows + body)
    place = out.index(tables["head"], 12 + 16 * n)
    out[place + 8 : place + 12] = struct.pack(">I", (0xB1B0AFBA - _sum(bytes(out))) & 0xFFFFFFFF)
    return bytes(out)


class Usage:
    """Glyphs drawn with each embedded program, or why a program must be left alone."""

    def __init__(self, doc: Document):
        self.doc, self.used, self.abstain = doc, {}, {}
        self.left = 1_000_000
        for ref, v in sorted(doc.objects.items()):
            if isinstance(v, dict) and v.get("Type") == "Font" and doc.get(v.get("Subtype")) == "Type0":
                program, reason = self.program(v)
                if program is not None:
                    self.used.setdefault(program, set())
                    if reason:
                        self.abstain.setdefault(program, reason)
        form = doc.dict_of(doc.catalog.get("AcroForm"))
        for font in doc.dict_of(doc.dict_of(form.get("DR")).get("Font")).values():
            program, _ = self.program(doc.dict_of(font))
            if program is not None:
                self.abstain.setdefault(program, "acroform_dr")
        for page in content.pages(doc):
            body = content.content_bytes(doc, page)
            self.stream(body, doc.dict_of(page.inherited.get("Resources")), frozenset())
            for annot in doc.get(page.dict.get("Annots")) or []:
                own = doc.dict_of(annot)
                if "DA" in own:
                    for program in self.used:
                        self.abstain.setdefault(program, "default_appearance")
                normal = doc.get(doc.dict_of(own.get("AP")).get("N"))
                for state in [normal] if isinstance(normal, Stream) else [doc.get(x) for x in (normal or {}).values()]:
                    if isinstance(state, Stream):
                        self.form(state, {}, frozenset())
        self.others()

    def program(self, font: dict) -> tuple[Ref | None, str | None]:
        """The program of a Type0 font with TrueType outlines, and why its codes are not understood."""
        kids = self.doc.get(font.get("DescendantFonts")) or []
        down = self.doc.dict_of(kids[0]) if kids else {}
        ref = self.doc.dict_of(down.get("FontDescriptor")).get("FontFile2")
        if self.doc.get(down.get("Subtype")) != "CIDFontType2" or not isinstance(ref, Ref):
            return None, None
        if self.doc.get(font.get("Encoding")) != "Identity-H":
            return ref, "unsupported_encoding"
        return ref, None if self.doc.get(down.get("CIDToGIDMap", "Identity")) == "Identity" or isinstance(self.doc.get(down.get("CIDToGIDMap")), Stream) else "unsupported_cid_map"

    def gids(self, font: dict, codes: bytes) -> set[int]:
        down = self.doc.dict_of((self.doc.get(font.get("DescendantFonts")) or [None])[0])
        table = self.doc.get(down.get("CIDToGIDMap"))
        cids = [int.from_bytes(codes[i : i + 2], "big") for i in range(0, len(codes) - 1, 2)]
        if isinstance(table, Stream):
            body = self.doc.decoded(table) or b""
            return {int.from_bytes(body[2 * c : 2 * c + 2], "big") for c in cids if 2 * c + 2 <= len(body)}
        return set(cids)

    def stream(self, data: bytes, resources: dict, active: frozenset) -> None:
        font, stack = None, []
        fonts, forms = self.doc.dict_of(resources.get("Font")), self.doc.dict_of(resources.get("XObject"))
        for op in content.operations(data):
            self.left -= 1
            if self.left < 0:
                self.abstain |= dict.fromkeys(self.used, "malformed_content")
                return
            if op.operator == "q":
                stack.append(font)
            elif op.operator == "Q" and stack:
                font = stack.pop()
            elif op.operator == "Tf" and op.operands:
                font = self.doc.dict_of(fonts.get(str(op.operands[0])))
            elif op.operator in ("Tj", "'", '"', "TJ") and op.operands and font:
                items = op.operands[0] if op.operator == "TJ" and isinstance(op.operands[0], list) else [op.operands[-1]]
                self.drawn(font, [x for x in items if isinstance(x, bytes)])
            elif op.operator == "Do" and op.operands:
                ref = forms.get(str(op.operands[0]))
                v = self.doc.get(ref)
                if isinstance(v, Stream) and v.dict.get("Subtype") == "Form" and ref not in active:
                    self.form(v, resources, active | {ref})

    def form(self, v: Stream, resources: dict, active: frozenset) -> None:
        data = self.doc.decoded(v)
        if data is None:
            self.abstain |= {p: self.abstain.get(p, "unresolved_resource") for p in self.used}
        elif len(active) < 64:
            self.stream(data, self.doc.dict_of(v.dict.get("Resources")) or resources, active)

    def drawn(self, font: dict, strings: list[bytes]) -> None:
        program, _ = self.program(font) if self.doc.get(font.get("Subtype")) == "Type0" else (None, None)
        if program is not None:
            for codes in strings:
                self.used.setdefault(program, set()).update(self.gids(font, codes))

    def others(self) -> None:
        """Programs that a font of another kind shares, or that resources outside the pages reach, are left alone."""
        for _, v in sorted(self.doc.objects.items()):
            if isinstance(v, dict) and v.get("Type") == "Font" and self.doc.get(v.get("Subtype")) in ("TrueType", "Type1", "MMType1"):
                ref = self.doc.dict_of(v.get("FontDescriptor")).get("FontFile2")
                if ref in self.used:
                    self.abstain.setdefault(ref, "shared_with_unsupported")
            if isinstance(v, Stream) and v.dict.get("PatternType") == 1:
                self.abstain |= {p: self.abstain.get(p, "untraversed_resource") for p in self.used}


def subset_fonts(doc: Document) -> dict[str, Any]:
    """Replace programs by smaller ones. Counts, bytes before and after, and abstentions by reason."""
    usage = Usage(doc)
    out: dict[str, Any] = {"subset": 0, "before": 0, "after": 0, "abstained": {}}

    def leave(reason: str) -> None:
        out["abstained"][reason] = out["abstained"].get(reason, 0) + 1

    for ref, gids in sorted(usage.used.items()):
        v = doc.get(ref)
        if ref in usage.abstain:
            leave(usage.abstain[ref])
            continue
        data = doc.decoded(v) if isinstance(v, Stream) else None
        if data is None:
            leave("decode_failed")
            continue
        small = subset(data, gids)
        packed = zlib.compress(small, 9) if small else None
        if packed is None or len(packed) >= len(v.raw):
            leave("invalid_or_no_savings")
            continue
        values = {k: x for k, x in v.dict.items() if k not in ("DecodeParms", "Length")}
        doc.objects[ref] = Stream(values | {"Filter": Name("FlateDecode"), "Length1": len(small)}, packed)
        out["subset"] += 1
        out["before"] += len(v.raw)
        out["after"] += len(packed)
    return out
