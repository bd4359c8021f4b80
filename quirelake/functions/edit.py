"""Text removal and replacement in one file."""

from __future__ import annotations

import math
import zlib
from typing import Any

import numpy as np

from ..options import EditOptions
from . import content, text
from .content import Operation, Page
from .pdf import Document, Encrypted, Name, PdfError, Ref, Stream, read, references, write_classic

#: What an edit does not look at.
NOT_INSPECTED = ("document_info", "xmp_metadata", "form_xobject_content", "annotation_appearance", "structure_tree", "embedded_files", "outlines")


class Limit(ValueError):
    """A budget is exceeded; the text is its kind."""


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def valid(r: dict) -> bool:
    box = [r[k] for k in ("x", "y", "width", "height")]
    return all(v is not None and math.isfinite(v) for v in box) and r["width"] > 0 and r["height"] > 0


def inside(r: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (r["x"] <= x) & (x <= r["x"] + r["width"]) & (r["y"] <= y) & (y <= r["y"] + r["height"])


def _box(doc: Document, value: Any) -> list[float] | None:
    v = doc.get(value)
    v = [doc.get(x) for x in v] if isinstance(v, list) else []
    return [float(x) for x in v] if len(v) == 4 and all(map(_number, v)) else None


def plain_geometry(doc: Document, page: Page, for_replacement: bool = False) -> bool:
    """No rotation or unit, and boxes that start at the origin. The replacement variant ignores the unit and does not
    order corners."""
    rotate, unit = doc.get(page.inherited.get("Rotate", 0)), doc.get(page.dict.get("UserUnit", 1))
    if not _number(rotate) or rotate % 360 or (not for_replacement and unit != 1):
        return False
    for key in ("MediaBox", "CropBox"):
        if key == "CropBox" and key not in page.inherited:
            continue
        box = _box(doc, page.inherited.get(key))
        if box is None:
            return False
        x, y = (box[0], box[1]) if for_replacement else (min(box[0], box[2]), min(box[1], box[3]))
        if abs(x) > text.TOLERANCE or abs(y) > text.TOLERANCE:
            return False
    return True


class Editor:
    """One document under edit: page texts, swaps of content streams, and the report's common parts."""

    def __init__(self, data: bytes, options: EditOptions):
        if len(data) > options.max_input_bytes:
            raise Limit("input_bytes")
        self.doc, self.options, self.spent = read(data), options, 0
        self.pages = content.pages(self.doc)

    def operations(self, page: Page) -> list[Operation] | None:
        """The page's operations; None if they cannot be rewritten safely."""
        left = min(self.options.max_page_bytes, self.options.max_total_bytes - self.spent)
        try:
            body = content.bounded_content(self.doc, page, left, self.options.max_streams)
        except content.StreamReadError as e:
            if str(e) == "too_large" and left < self.options.max_page_bytes:
                raise Limit("total_decompressed_bytes") from e
            return None
        self.spent += len(body)
        ops = content.operations(body)
        if len(ops) > self.options.max_operators or any(o.operator == "BI" for o in ops) or not ops and body.strip():
            return None
        return ops

    def swap(self, at: int, ops: list[Operation]) -> tuple[Any, Ref]:
        """Give the page one new content stream; the old value comes back."""
        page = self.pages[at]
        old = page.dict.get("Contents")
        ref = Ref(max((r.num for r in self.doc.objects), default=0) + 1, 0)
        self.doc.objects[ref] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(text.written(ops), 9))
        page.dict["Contents"] = ref
        return old, ref

    def restore(self, at: int, old: Any, new: Ref) -> None:
        self.pages[at].dict["Contents"] = old
        del self.doc.objects[new]

    def drop_unreferenced(self, old: list[Ref]) -> None:
        used = {t for v in [self.doc.trailer, *self.doc.objects.values()] for _, t in references(v)}
        for ref in old:
            if ref not in used:
                self.doc.objects.pop(ref, None)

    def inspect(self, regions: list[dict], ids: dict[int, list[Ref]]) -> tuple[list[dict], list[dict]]:
        """Risks that text remains elsewhere, and gaps where that could not be seen. A failed look-up is a gap."""
        risks, gaps = [], []
        for at in sorted({r["page"] for r in regions if 0 <= r["page"] < len(self.pages)}):
            page, own = self.pages[at], [r for r in regions if r["page"] == at and valid(r)]
            shared = [k for k, p in enumerate(self.pages) if k != at and set(content.content_refs(self.doc, p)) & set(ids.get(at, []))]
            if shared:
                risks.append(("shared_content_stream", at, ",".join(map(str, shared))))
            ops = content.operations(content.content_bytes(self.doc, page))
            forms = text.form_names(self.doc, page)
            risks += [("form_xobject", at, str(o.operands[0])) for o in ops if o.operator == "Do" and o.operands and str(o.operands[0]) in forms]
            marks = {k for o in ops if o.operator == "BDC" for k in self.marks(page, o)}
            risks += [(k, at, "") for k in marks]
            annots = page.dict.get("Annots")
            if annots is not None and not isinstance(self.doc.get(annots), list):
                gaps.append(("malformed_annots", at, ""))
                continue
            for k, annot in enumerate(self.doc.get(annots) or []):
                if isinstance(annot, Ref) and self.doc.get(annot) is None:
                    gaps.append(("broken_reference", at, f"{annot.num} {annot.gen} R"))
                    continue
                box = _box(self.doc, self.doc.dict_of(annot).get("Rect"))
                if box is None:
                    gaps.append(("malformed_rect", at, str(k)))
                if box is None or any(self._meets(box, r) for r in own):
                    risks.append(("annotation", at, str(k)))
        order = ("shared_content_stream", "form_xobject", "annotation", "optional_content", "actual_text")
        rows = lambda xs, key: [{key: k, "page": p, "detail": d} for k, p, d in xs]
        return rows(sorted(set(risks), key=lambda x: (order.index(x[0]), x[1:])), "kind"), rows(sorted(set(gaps)), "reason")

    @staticmethod
    def _meets(box: list[float], r: dict) -> bool:
        """Strict overlap; no area never meets."""
        x0, x1, y0, y1 = min(box[0], box[2]), max(box[0], box[2]), min(box[1], box[3]), max(box[1], box[3])
        return x0 < x1 and y0 < y1 and x0 < r["x"] + r["width"] and r["x"] < x1 and y0 < r["y"] + r["height"] and r["y"] < y1

    def marks(self, page: Page, op: Operation) -> set[str]:
        """optional_content and actual_text, where a marked-content operator brings them."""
        if len(op.operands) < 2:
            return set()
        values = op.operands[1]
        if isinstance(values, Name):
            values = self.doc.dict_of(self.doc.dict_of(self.doc.dict_of(page.inherited.get("Resources")).get("Properties")).get(values))
        values = values if isinstance(values, dict) else {}
        out = set()
        if op.operands[0] == "OC" or values.get("Type") in ("OCG", "OCMD"):
            out.add("optional_content")
        if "ActualText" in values or "Alt" in values:
            out.add("actual_text")
        return out

    def signature(self) -> dict:
        from ..sources.tables import _Facts

        found = _Facts(self.doc).signature()
        return {k: found[k] for k in ("sig_flags", "sig_field", "perms")}

    def saved(self) -> bytes:
        return write_classic(self.doc)


_NO_SIGNATURE = {"sig_flags": False, "sig_field": False, "perms": False}


def _report(name: str, rows: list[dict], data: bytes, **more: Any) -> dict:
    return {"content": data, "modified": False, "error": None, name: rows, "residual_risks": [], "inspection_gaps": []} | _NO_SIGNATURE | more


def remove(data: bytes, regions: list[dict], options: EditOptions) -> dict:
    """Erase the glyphs of each region whole or not at all. Without a change the bytes stay the same."""
    rows = [{"id": r["id"], "page": r["page"], "status": None, "removed_glyphs": 0} for r in regions]

    def all_are(status: str, **more: Any) -> dict:
        return _report("regions", [r | {"status": status} for r in rows], data, **more)

    try:
        if len(regions) > options.max_regions:
            raise Limit("regions")
        ed = Editor(data, options)
    except Encrypted:
        return all_are("skipped_encrypted", inspection_gaps=[{"reason": "encrypted", "page": None, "detail": ""}])
    except (PdfError, Limit, ValueError, TypeError, KeyError, IndexError) as e:
        return all_are("skipped_content", error=str(e)[:200])
    ids = {i: content.content_refs(ed.doc, p) for i, p in enumerate(ed.pages)}
    by_page: dict[int, list[int]] = {}
    for k, r in enumerate(regions):
        if not valid(r) or not 0 <= r["page"] < len(ed.pages):
            rows[k]["status"] = "skipped_invalid_region"
        else:
            by_page.setdefault(r["page"], []).append(k)
    changed, old = False, []
    try:
        for at, ks in sorted(by_page.items()):
            found = _erase(ed, at, [(k, regions[k]) for k in ks])
            for k in ks:
                rows[k] |= {"status": found[1][k][0], "removed_glyphs": found[1][k][1]}
            if found[0]:
                changed, old = True, old + ids[at]
    except Limit as e:
        return all_are("skipped_content", error=f"limit: {e}")
    if changed:
        ed.drop_unreferenced(old)
    risks, gaps = ed.inspect(regions, ids)
    return _report("regions", rows, ed.saved() if changed else data, modified=changed, residual_risks=risks, inspection_gaps=gaps, **ed.signature())


def _erase(ed: Editor, at: int, regions: list[tuple[int, dict]]) -> tuple[bool, dict[int, tuple[str, int]]]:
    page = ed.pages[at]
    every = lambda status: (False, {k: (status, 0) for k, _ in regions})
    if not plain_geometry(ed.doc, page):
        return every("skipped_page_geometry")
    if (ops := ed.operations(page)) is None:
        return every("skipped_content")
    seen = text.interpret(ed.doc, page, ops)
    blocked, hits = set(), {k: [] for k, _ in regions}
    if seen.runs:
        at_, (px, py) = seen.columns(), seen.probes()
        upright, clips = at_["upright"], np.array([r.mode >= 4 for r in seen.runs])[at_["run"]]
        free = upright.copy()  # an upright glyph goes to the first region that holds it
        for k, r in regions:
            held = inside(r, px, py)
            if (~upright & (held | inside(r, at_["x"], at_["y"]))).any():
                blocked.add(k)
            own = free & held
            if (own & clips).any():  # text that clips cannot be taken out alone
                blocked.add(k)
            hits[k] = np.flatnonzero(own).tolist()
            free &= ~held
    unmeasured = any(why != "form_xobject" for _, why in seen.unsupported)
    out, gone = {}, set()
    for k, _ in regions:
        if k in blocked:
            out[k] = ("skipped_unsupported_text", 0)
        elif not hits[k]:
            out[k] = ("skipped_unsupported_text" if unmeasured else "nothing_found", 0)
        else:
            out[k] = ("removed_unverified" if unmeasured else "removed", len(hits[k]))
            gone |= set(hits[k])
    if not gone:
        return False, out
    before, new = ed.swap(at, text.without(ops, seen, gone))
    again = text.interpret(ed.doc, page, content.operations(content.content_bytes(ed.doc, page)))
    if not text.same_rest(seen, gone, again):
        ed.restore(at, before, new)
        return False, {k: ("skipped_verification", 0) if v[1] else v for k, v in out.items()}
    return True, out


def scan_order(page: int, count: int) -> list[int]:
    """The page itself, then its neighbours by distance, the next one before the one before."""
    return sorted(range(count), key=lambda p: (abs(p - page), p < page))


def replace(data: bytes, requests: list[dict], options: EditOptions) -> dict:
    """Write new text with codes of the same font that the document already draws. One request after another."""
    blank = {"status": None, "replaced_glyphs": 0, "original_text": None, "original_advance": None, "new_advance": None, "scanned_pages": [], "scan_incomplete": False}
    rows = [{"id": r["id"], "page": r["page"], "new_text": r["text"]} | blank for r in requests]

    def all_are(status: str, **more: Any) -> dict:
        return _report("replacements", [r | {"status": status} for r in rows], data, **more)

    try:
        if len(requests) > options.max_regions:
            raise Limit("regions")
        ed = Editor(data, options)
    except Encrypted:
        return all_are("skipped_encrypted", inspection_gaps=[{"reason": "encrypted", "page": None, "detail": ""}])
    except (PdfError, Limit, ValueError, TypeError, KeyError, IndexError) as e:
        return all_are("skipped_content", error=str(e)[:200])
    ids = {i: content.content_refs(ed.doc, p) for i, p in enumerate(ed.pages)}
    changed: list[dict] = []
    try:
        for r, row in zip(requests, rows, strict=True):
            row["status"] = _replace_one(ed, r, row, changed)
            if row["status"] == "replaced":
                changed.append(r)
    except Limit as e:
        return all_are("skipped_content", error=f"limit: {e}")
    if changed:
        ed.drop_unreferenced([x for r in changed for x in ids[r["page"]]])
    risks, gaps = ed.inspect(requests, ids)
    return _report("replacements", rows, ed.saved() if changed else data, modified=bool(changed), residual_risks=risks, inspection_gaps=gaps, **ed.signature())


def _replace_one(ed: Editor, r: dict, row: dict, done: list[dict]) -> str:
    if not (valid(r) and r["id"] and r["text"] and 0 <= r["page"] < len(ed.pages)):
        return "skipped_invalid_region"
    page = ed.pages[r["page"]]
    if not plain_geometry(ed.doc, page, for_replacement=True):
        return "skipped_page_geometry"
    if (ops := ed.operations(page)) is None:
        return "skipped_content"
    risky = any(ed._meets(b, r) for a in ed.doc.get(page.dict.get("Annots")) or [] if (b := _box(ed.doc, ed.doc.dict_of(a).get("Rect"))))
    marked = [(i, ed.marks(page, o)) for i, o in enumerate(ops) if o.operator == "BDC"]
    if risky or any("optional_content" in m for _, m in marked):
        return "skipped_semantics"
    seen = text.interpret(ed.doc, page, ops)
    hit = np.flatnonzero(inside(r, *seen.probes())).tolist()
    if not hit:
        return "skipped_unsupported_text" if seen.unsupported else "nothing_found"
    glyphs = seen.glyphs
    chosen = [glyphs[n] for n in hit]
    first = chosen[0]
    flipped = lambda g: abs(g.baseline[0] - 1) <= text.UPRIGHT and abs(abs(g.ascent[1]) - 1) <= text.UPRIGHT
    if not all(map(flipped, chosen)) or first.mode >= 4:
        return "skipped_unsupported_text"
    if len({g.font_key for g in chosen}) > 1:
        return "skipped_unsupported_font"
    if any(g.text is None for g in chosen):
        return "skipped_ambiguous_mapping"
    if hit[-1] - hit[0] + 1 != len(hit) or len({(g.op_index, g.element) for g in chosen}) > 1 or any(abs(g.y - first.y) > text.TOLERANCE for g in chosen):
        return "skipped_layout"
    if any(d["page"] == r["page"] and _overlap(d, r) for d in done):
        return "skipped_stale_selection"
    if _under_actual_text(ops, first.op_index, marked):
        return "skipped_semantics"
    codes, row["scanned_pages"], row["scan_incomplete"] = _codes(ed, r["page"], first.font_key, set(r["text"]))
    if any(c not in codes for c in r["text"]):
        return "skipped_no_reusable_code"
    if any(len(codes[c]) > 1 for c in r["text"]):
        return "skipped_ambiguous_mapping"
    if not first.scale:
        return "skipped_layout"
    own = [next(iter(codes[c])) for c in r["text"]]
    font = text.page_fonts(ed.doc, page)[first.font]
    state = (first.own_advance / (first.scale / first.size if first.size else 1)) - font.widths.get(int.from_bytes(first.code, "big"), font.default) / 1000 * first.size
    old_advance = sum(g.own_advance for g in chosen)
    ratio = first.scale / first.size if first.size else 1.0
    new_advance = sum((font.widths.get(int.from_bytes(c, "big"), font.default) / 1000 * first.size + state) * ratio for c in own)
    row |= {"original_text": "".join(g.text for g in chosen), "original_advance": old_advance, "new_advance": new_advance}
    if new_advance > old_advance + text.TOLERANCE:
        after = [g for g in glyphs if abs(g.y - first.y) <= text.TOLERANCE and g.x > chosen[-1].x]
        room = min(g.x for g in after) - (chosen[-1].x + chosen[-1].advance) if after else old_advance * ed.options.overflow_share
        if new_advance - old_advance > room + text.TOLERANCE:
            return "skipped_layout"
    before, new = ed.swap(r["page"], _rewritten(ops, glyphs, hit, b"".join(own), old_advance - new_advance))
    again = text.interpret(ed.doc, page, content.operations(content.content_bytes(ed.doc, page)))
    if not text.same_rest(seen, set(hit), again, range(hit[0], hit[0] + len(own))):
        ed.restore(r["page"], before, new)
        return "skipped_verification"
    row["replaced_glyphs"] = len(hit)
    return "replaced"


def _overlap(a: dict, b: dict) -> bool:
    return a["x"] < b["x"] + b["width"] and b["x"] < a["x"] + a["width"] and a["y"] < b["y"] + b["height"] and b["y"] < a["y"] + a["height"]


def _under_actual_text(ops: list[Operation], at: int, marked: list[tuple[int, set[str]]]) -> bool:
    actual, stack = {i for i, m in marked if "actual_text" in m}, []
    for i, op in enumerate(ops[: at + 1]):
        if op.operator in ("BMC", "BDC"):
            stack.append(i in actual)
        elif op.operator == "EMC" and stack:
            stack.pop()
    return any(stack)


def _codes(ed: Editor, page: int, font_key: str, wanted: set[str]) -> tuple[dict[str, set[bytes]], list[int], bool]:
    """Characters and the codes drawn for them with the font, on at most so many of the nearest pages that use it."""
    out: dict[str, set[bytes]] = {}
    scanned, missing = [], False
    for p in scan_order(page, len(ed.pages)):
        if len(scanned) >= ed.options.scan_pages or wanted <= out.keys():
            break
        if font_key not in {f.key for f in text.page_fonts(ed.doc, ed.pages[p]).values()}:
            continue
        ops = ed.operations(ed.pages[p])
        if ops is None:
            missing = True
            continue
        scanned.append(p)
        for r in text.interpret(ed.doc, ed.pages[p], ops).runs:
            if r.of.key == font_key:
                for code in set(r.parts()):
                    if shown := r.of.text.get(code):
                        out.setdefault(shown, set()).add(code)
    return out, sorted(scanned), missing


def _rewritten(ops: list[Operation], glyphs: list[text.Glyph], hit: list[int], new: bytes, shift: float) -> list[Operation]:
    """The string of the selection with the new codes in it, and a step so that the rest of the line stays."""
    first, last = glyphs[hit[0]], glyphs[hit[-1]]
    out = list(ops)
    op = ops[first.op_index]
    items = list(op.operands[0]) if op.operator == "TJ" else [op.operands[-1]]
    own = bytes(items[first.element])
    step = round(-shift * 1000 / first.scale, 6)
    row = [own[: first.offset] + new] + ([step] if abs(step) > 1e-6 else []) + [own[last.offset + len(last.code) :]]
    items[first.element : first.element + 1] = [x for x in row if x != b""]
    lead = [Operation("Tw", [op.operands[0]]), Operation("Tc", [op.operands[1]])] if op.operator == '"' else []
    lead += [Operation("T*", [])] if op.operator in ("'", '"') else []
    out[first.op_index : first.op_index + 1] = [*lead, Operation("TJ", [items])]
    return out
