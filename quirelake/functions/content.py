"""Content streams: operators with operands, inline images, and the page tree that leads to them."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from . import filters
from .pdf import _CONSTANTS, _END, _ESCAPED, _NUM, _TOKEN, Document, Lexer, Name, Operator, PdfError, Ref, Stream

#: Fixed value: levels of the page tree.
TREE_LEVELS = 64
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
_WHITE = b"\0\t\n\f\r "
_DELIMITERS = b"()<>[]{}/%"
# an operator of letters, and the string before it if there is one: most of a page's content
_STEP = re.compile(rb"[\0\t\n\f\r ]*+(?:\(([^()\\]*+(?:\\[()\\][^()\\]*+)*+)\)[\0\t\n\f\r ]*+)?([A-Za-z*]++)(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)")
_WORDS: dict[bytes, str] = {}
_NOT_STEPS = frozenset((b"BI", *_CONSTANTS))


class Operation(NamedTuple):
    operator: str
    operands: list


class InlineImages(NamedTuple):
    count: int
    data_bytes: int
    color_count: int


class Page(NamedTuple):
    ref: Ref
    dict: dict
    inherited: dict  # Resources, MediaBox, CropBox and Rotate, the nearest of each


def pages(doc: Document) -> list[Page]:
    """Leaves in reading order. A cycle or too many levels is an error."""
    out: list[Page] = []

    def walk(ref: Any, above: dict, path: frozenset) -> None:
        if ref in path or len(path) >= TREE_LEVELS:
            raise PdfError("page tree has a cycle or is too deep")
        node = doc.dict_of(ref)
        own = above | {k: node[k] for k in INHERITED if k in node}
        kids = doc.get(node.get("Kids"))
        if isinstance(kids, list) and node.get("Type") != "Page":
            for kid in kids:
                if isinstance(kid, Ref):
                    walk(kid, own, path | {ref})
        elif node:
            out.append(Page(ref, node, own))

    root = doc.catalog.get("Pages")
    if isinstance(root, Ref):
        walk(root, {}, frozenset())
    return out


def content_refs(doc: Document, page: Page) -> list[Ref]:
    """The page's content streams; an indirect array counts as its members."""
    own = page.dict.get("Contents")
    if isinstance(own, Ref) and isinstance(doc.get(own), list):
        own = doc.get(own)
    return [r for r in own if isinstance(r, Ref)] if isinstance(own, list) else [own] if isinstance(own, Ref) else []


def content_bytes(doc: Document, page: Page) -> bytes:
    """All content of a page, streams joined by a line end; what cannot be decoded is left out."""
    parts = [doc.decoded(s) for r in content_refs(doc, page) if isinstance(s := doc.get(r), Stream)]
    return b"\n".join(p for p in parts if p is not None)


class StreamReadError(ValueError):
    """kind: unsupported_filter, predictor, too_large, malformed, missing or too_many_streams."""


def bounded_content(doc: Document, page: Page, cap: int, calls: int) -> bytes:
    """Content read only where it is plain or a single FlateDecode without predictor, up to cap bytes and calls streams."""
    out, left = [], cap
    refs = content_refs(doc, page)
    if len(refs) > calls:
        raise StreamReadError("too_many_streams")
    for ref in refs:
        stream = doc.get(ref)
        if not isinstance(stream, Stream):
            raise StreamReadError("missing")
        names, parms = doc.filters(stream)
        if names and names != ["FlateDecode"]:
            raise StreamReadError("unsupported_filter")
        if any(p.get("Predictor", 1) != 1 for p in parms):
            raise StreamReadError("predictor")
        body = filters.inflate(stream.raw, left, lenient=True) if names else stream.raw
        if body is None:
            raise StreamReadError("too_large" if filters.inflate(stream.raw, filters.DECODE_CAP, lenient=True) is not None else "malformed")
        if len(body) > left:
            raise StreamReadError("too_large")
        left -= len(body)
        out.append(body)
    return b"\n".join(out)


def operations(data: bytes) -> list[Operation]:
    """Operators in order. An inline image is one operation `BI` with its dictionary and data."""
    out: list[Operation] = []
    operands: list = []
    lexer, at = Lexer(data, refs=False), 0
    step, token = _STEP.match, _TOKEN.match
    while True:
        if (m := step(data, at)) and (text := m[2]) not in _NOT_STEPS:
            if (shown := m[1]) is not None:
                operands.append(_ESCAPED.sub(rb"\1", shown) if b"\\" in shown else shown)
            if (word := _WORDS.get(text)) is None:
                word = text.decode("latin-1")
                if len(_WORDS) < 256 and len(word) < 8:
                    _WORDS[text] = word
            out.append(Operation(word, operands))
            operands = []
            at = m.end()
            continue
        if (m := token(data, at)) and m.lastindex == _NUM:
            text = m[_NUM]
            operands.append(float(text) if b"." in text else int(text))
            at = m.end()
            continue
        lexer.at = at
        v = lexer.value()
        at = lexer.at
        if v is _END:
            break
        if not isinstance(v, Operator):
            operands.append(v)
        elif v == b"BI":
            found = _inline(data, at)
            if not found:
                break
            values, start, end, at = found
            out.append(Operation("BI", [values, data[start:end]]))
            operands = []
        else:
            out.append(Operation(v.decode("latin-1"), operands))
            operands = []
    return out


def _inline(data: bytes, at: int) -> tuple[dict, int, int, int] | None:
    """From after BI: dictionary, first and past-the-last byte of the data, place after EI."""
    lexer, values = Lexer(data, at, refs=False), {}
    while True:
        key = lexer.value()
        if isinstance(key, Operator) and key == b"ID":
            break
        if not isinstance(key, Name):
            return None
        v = lexer.value()
        if v is _END or isinstance(v, Operator):
            return None
        values[str(key)] = v
    start = lexer.at + (2 if data[lexer.at : lexer.at + 2] == b"\r\n" else 1 if data[lexer.at : lexer.at + 1] and data[lexer.at] in _WHITE else 0)
    for m in re.finditer(rb"(?<=[\0\t\n\f\r ])EI(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)", data[start:]):
        return values, start, start + m.start() - 1, start + m.end()
    return None


def is_color_inline(values: dict) -> bool:
    """Neither gray nor a stencil mask."""
    space = values.get("CS", values.get("ColorSpace"))
    return space not in ("G", "DeviceGray") and values.get("IM", values.get("ImageMask")) is not True


def inline_images(data: bytes) -> InlineImages:
    count = size = color = 0
    for op in operations(data):
        if op.operator == "BI":
            values, body = op.operands
            count, size, color = count + 1, size + len(body), color + is_color_inline(values)
    return InlineImages(count, size, color)


def shown_text_bytes(ops: list[Operation]) -> int:
    """Bytes of the strings that text operators show."""
    total = 0
    for op in ops:
        if op.operator in ("Tj", "'", '"') and op.operands and isinstance(op.operands[-1], bytes):
            total += len(op.operands[-1])
        elif op.operator == "TJ" and op.operands and isinstance(op.operands[0], list):
            total += sum(len(x) for x in op.operands[0] if isinstance(x, bytes))
    return total
