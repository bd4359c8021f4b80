"""Reading and writing PDF files: bytes to an object map and back.

Values: None, bool, int, float, Name, bytes (strings), list, dict (keys without the slash), Ref, Stream.
"""

from __future__ import annotations

import re
import zlib
from typing import Any, NamedTuple

from . import filters


class Name(str):
    __slots__ = ()


class Hex(bytes):
    """A string that was written in hexadecimal."""


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    __slots__ = ("dict", "raw")

    def __init__(self, values: dict, raw: bytes):
        self.dict, self.raw = values, raw

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Stream) and (self.dict, self.raw) == (other.dict, other.raw)

    __hash__ = None


class Operator(bytes):
    """A bare word that is neither a number nor a constant."""


class PdfError(ValueError):
    pass


class Encrypted(PdfError):
    pass


_END = object()
_TOKEN = re.compile(
    rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\0\t\n\f\r ]*)*"
    rb"(?:(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)|(?P<name>/[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<open><<)|(?P<close>>>)|(?P<hex><[^>]*>)|(?P<str>\()|(?P<brk>[\[\]{}])|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+)|(?P<odd>[>)]))"
)
_NUM, _NAME, _OPEN, _CLOSE, _HEX, _STR, _BRK, _WORD, _ODD = range(1, 10)  # groups of _TOKEN
_REF = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)")
_STRING = re.compile(rb"[()\\]")
# shortcuts for what is common; anything else goes token by token
_WHOLE_STRING = re.compile(rb"([^()\\]*(?:\\[()\\][^()\\]*)*)\)")
_ESCAPED = re.compile(rb"\\([()\\])")
_WHOLE_NUMBERS = re.compile(rb"([0-9\t\n\f\r ]*)\]")
_PAIR = re.compile(
    rb"[\0\t\n\f\r ]*(?:/([^\0\t\n\f\r ()<>\[\]{}/%#]*)(?=[\0\t\n\f\r ()<>\[\]{}/%])"
    rb"(?:[\0\t\n\f\r ]*(?:(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?=[\0\t\n\f\r ()<>\[\]{}/%])|([+-]?\d+)(?=[\0\t\n\f\r ()<>\[\]{}/%])(?![\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R)|/([^\0\t\n\f\r ()<>\[\]{}/%#]*)(?=[\0\t\n\f\r ()<>\[\]{}/%])))?|(>>))"
)
_PAIR_KEY, _PAIR_REF, _PAIR_INT, _PAIR_NAME, _PAIR_END = 1, 3, 4, 5, 6  # last groups of _PAIR
_OCTAL = re.compile(rb"[0-7]{1,3}")
_OBJECT = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")
_STREAM = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)?")
_ENDSTREAM = re.compile(rb"[\0\t\n\f\r ]*endstream")
_XREF = re.compile(rb"[\0\t\n\f\r ]*xref")
_XREF_ROWS = re.compile(rb"[\0\t\n\f\r ]*((?:\d{10} \d{5} [nf][ \r\n][\r\n])+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}
_CONSTANTS = {b"true": True, b"false": False, b"null": None}
_DEEPEST = 256
#: Names seen lately, by their bytes and as written; as many as this are kept.
_KEPT_NAMES = 8192
_names: dict[bytes, Name] = {}
_shown_names: dict[str, bytes] = {}


def _name(raw: bytes) -> Name:
    """A name from its bytes after the slash."""
    if (known := _names.get(raw)) is None:
        known = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1"))
        if len(_names) < _KEPT_NAMES and len(raw) < 128:
            _names[raw] = known
    return known


class Lexer:
    """Values from bytes. refs: whether `n g R` is a reference (not in content streams)."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def value(self, depth: int = 0) -> Any:
        m = _TOKEN.match(self.data, self.at)
        if not m:
            self.at = len(self.data)
            return _END
        self.at, kind = m.end(), m.lastindex
        if depth > _DEEPEST:
            raise PdfError("nested too deeply")
        text = m[kind]
        if kind == _NUM:
            if self.refs and text.isdigit() and (r := _REF.match(self.data, self.at)):
                self.at = r.end()
                return Ref(int(text), int(r[1]))
            return float(text) if b"." in text else int(text)
        if kind == _NAME:
            return _name(text[1:])
        if kind == _STR:
            return self._string()
        if kind == _HEX:
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", text)
            return Hex(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        if kind == _OPEN:
            return self._dict(depth)
        if text == b"[":
            if depth < _DEEPEST and (r := _WHOLE_NUMBERS.match(self.data, self.at)):
                self.at = r.end()
                return list(map(int, r[1].split()))
            out = []
            while (v := self.value(depth + 1)) is not _END and v != b"]":
                out.append(v)
            return out
        if kind == _WORD:
            return _CONSTANTS[text] if text in _CONSTANTS else Operator(text)
        return Operator(text)

    def _dict(self, depth: int) -> dict:
        out: dict[str, Any] = {}
        data, quick = self.data, self.refs and depth < _DEEPEST
        while True:
            if quick and (m := _PAIR.match(data, self.at)):
                self.at, kind = m.end(), m.lastindex
                if kind == _PAIR_END:
                    return out
                key = str(_name(m[1]))
                if kind == _PAIR_REF:
                    out[key] = Ref(int(m[2]), int(m[3]))
                    continue
                if kind == _PAIR_INT:
                    out[key] = int(m[4])
                    continue
                if kind == _PAIR_NAME:
                    out[key] = _name(m[5])
                    continue
            else:
                key = self.value(depth + 1)
                if key is _END or isinstance(key, Operator) and key == b">>":
                    return out
                if not isinstance(key, Name):
                    continue
                key = str(key)
            v = self.value(depth + 1)
            if isinstance(v, Operator) and v == b">>":
                return out
            out[key] = v

    def _string(self) -> bytes:
        if m := _WHOLE_STRING.match(self.data, self.at):
            self.at = m.end()
            return _ESCAPED.sub(rb"\1", m[1]) if b"\\" in m[1] else m[1]
        out, depth = bytearray(), 1
        while m := _STRING.search(self.data, self.at):
            out += self.data[self.at : m.start()]
            self.at = m.end()
            c = m[0]
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    return bytes(out)
            else:
                nxt = self.data[self.at : self.at + 1]
                if o := _OCTAL.match(self.data, self.at):
                    out.append(int(o[0], 8) & 255)
                    self.at = o.end()
                elif nxt in b"\r\n" and nxt:
                    self.at += 2 if self.data[self.at : self.at + 2] == b"\r\n" else 1
                else:
                    out += _ESCAPES.get(nxt, nxt)
                    self.at += 1
                continue
            out += c
        self.at = len(self.data)
        return bytes(out)


class Document:
    """Objects by number, and the trailer. Objects of a later section replace those of an earlier one."""

    def __init__(self, objects: dict[Ref, Any], trailer: dict, version: str = "1.7"):
        self.objects, self.trailer, self.version = objects, trailer, version

    def get(self, value: Any, hops: int = 32) -> Any:
        while isinstance(value, Ref) and hops:
            value, hops = self.objects.get(value), hops - 1
        return None if isinstance(value, Ref) else value

    def dict_of(self, value: Any) -> dict:
        value = self.get(value)
        return value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    @property
    def catalog(self) -> dict:
        return self.dict_of(self.trailer.get("Root"))

    def filters(self, stream: Stream) -> tuple[list[str], list[dict]]:
        names = self.get(stream.dict.get("Filter", stream.dict.get("F")))
        parms = self.get(stream.dict.get("DecodeParms", stream.dict.get("DP")))
        names = [self.get(n) for n in names] if isinstance(names, list) else [names] if names is not None else []
        parms = [self.dict_of(p) for p in parms] if isinstance(parms, list) else [self.dict_of(parms)] if parms else []
        return [str(n) for n in names], [{k: self.get(v) for k, v in p.items()} for p in parms]

    def decoded(self, stream: Stream) -> bytes | None:
        names, parms = self.filters(stream)
        return filters.decode(stream.raw, names, parms)


#: What is or may hold a reference.
_HOLDERS = (Ref, Stream, dict, list)


def references(value: Any, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Ref]]:
    """(key path, target) of every reference in a value."""
    out, todo = [], [(value, path)]
    while todo:
        v, p = todo.pop()
        if isinstance(v, Ref):
            out.append((p, v))
        elif isinstance(v, Stream):
            todo.append((v.dict, p))
        elif isinstance(v, dict):
            todo += [(x, (*p, k)) for k, x in v.items() if isinstance(x, _HOLDERS)]
        elif isinstance(v, list):
            todo += [(x, (*p, str(i))) for i, x in enumerate(v) if isinstance(x, _HOLDERS)]
    return out


def read(data: bytes) -> Document:
    """The document, or PdfError; Encrypted if it is so."""
    head = data.find(b"%PDF-")
    if head < 0:
        raise PdfError("no PDF header")
    try:
        doc = _by_xref(data)
    except (PdfError, ValueError, IndexError, KeyError, TypeError, OverflowError, RecursionError):
        doc = _by_scan(data)
    if doc.trailer.get("Encrypt") is not None:
        raise Encrypted("encrypted")
    if not doc.catalog:
        raise PdfError("no catalog")
    doc.version = data[head + 5 : head + 8].decode("latin-1")
    return doc


def _object_at(data: bytes, at: int, length_of=None) -> tuple[Ref, Any]:
    m = _OBJECT.match(data, at)
    if not m:
        raise PdfError(f"no object at {at}")
    lexer = Lexer(data, m.end())
    value = lexer.value()
    if value is _END or isinstance(value, Operator):
        value = None
    if isinstance(value, dict) and (s := _STREAM.match(data, lexer.at)):
        n = value.get("Length")
        n = length_of(n) if isinstance(n, Ref) and length_of else n
        if not isinstance(n, int) or n < 0 or not _ENDSTREAM.match(data, s.end() + n):
            end = data.find(b"endstream", s.end())
            if end < 0:
                raise PdfError("stream without an end")
            n = len(data[s.end() : end].removesuffix(b"\n").removesuffix(b"\r"))
        value = Stream(value, data[s.end() : s.end() + n])
    return Ref(int(m[1]), int(m[2])), value


def _by_xref(data: bytes) -> Document:
    m = re.search(rb"startxref[\0\t\n\f\r ]+(\d+)", data[-2048:])
    if not m:
        raise PdfError("no startxref")
    at, seen, trailer, where, packed = int(m[1]), set(), {}, {}, {}
    todo = [at]
    while todo:
        at = todo.pop(0)
        if at in seen or at >= len(data):
            continue
        seen.add(at)
        own = _xref_table(data, at, where) if _XREF.match(data, at) else _xref_stream(data, at, where, packed)
        for k, v in own.items():
            trailer.setdefault(k, v)
        todo += [x for k in ("XRefStm", "Prev") if isinstance(x := own.get(k), int)]
    if "Root" not in trailer:
        raise PdfError("no trailer")
    objects: dict[Ref, Any] = {}

    def length_of(ref: Ref) -> int | None:
        return _object_at(data, where[ref.num])[1] if ref.num in where else None

    for num, place in where.items():
        if place is not None:
            ref, value = _object_at(data, place, length_of)
            if ref.num != num:
                raise PdfError("cross-reference points to another object")
            objects[ref] = value
    _unpack(objects, {k: v for k, v in packed.items() if k not in where})
    return Document(objects, {k: v for k, v in trailer.items() if k not in ("Prev", "XRefStm", "W", "Index", "Length", "Filter", "DecodeParms", "Type")})


def _xref_table(data: bytes, at: int, where: dict) -> dict:
    lexer = Lexer(data, data.index(b"xref", at) + 4)
    while True:
        first = lexer.value()
        if isinstance(first, Operator) and first == b"trailer":
            trailer = lexer.value()
            if not isinstance(trailer, dict):
                raise PdfError("no trailer")
            return trailer
        count = lexer.value()
        if isinstance(count, int) and count > 0 and (m := _XREF_ROWS.match(data, lexer.at)) and m.end() - m.start(1) >= 20 * count:
            start = lexer.at = m.start(1)
            lexer.at += 20 * count
            for i in range(count):
                row = start + 20 * i
                where.setdefault(first + i, int(data[row : row + 10]) if data[row + 17] == 0x6E else None)
            continue
        for i in range(count):
            place, _, kind = lexer.value(), lexer.value(), lexer.value()
            where.setdefault(first + i, place if kind == b"n" else None)


def _xref_stream(data: bytes, at: int, where: dict, packed: dict) -> dict:
    _, stream = _object_at(data, at)
    if not isinstance(stream, Stream) or stream.dict.get("Type") != "XRef":
        raise PdfError("no cross-reference stream")
    rows, widths = Document({}, {}).decoded(stream), stream.dict["W"]
    size = sum(widths)
    index = stream.dict.get("Index", [0, stream.dict["Size"]])
    nums = [n for a, c in zip(index[::2], index[1::2], strict=True) for n in range(a, a + c)]
    for i, num in enumerate(nums[: len(rows) // size]):
        row, f, p = rows[i * size : (i + 1) * size], [], 0
        for w in widths:
            f.append(int.from_bytes(row[p : p + w], "big") if w else None)
            p += w
        kind = 1 if f[0] is None else f[0]
        if num in where or num in packed:
            continue
        if kind == 2:
            packed[num] = (f[1], f[2] or 0)
        else:
            where[num] = f[1] if kind == 1 else None
    return stream.dict


def _unpack(objects: dict[Ref, Any], packed: dict) -> None:
    """Objects from object streams; packed: number -> (stream's number, place in it)."""
    inside: dict[int, dict[int, Any]] = {}
    for num, (box, _) in packed.items():
        if box not in inside:
            inside[box] = _object_stream(objects.get(Ref(box, 0)))
        if num in inside[box]:
            objects[Ref(num, 0)] = inside[box][num]
    for ref in [r for r, v in objects.items() if isinstance(v, Stream) and v.dict.get("Type") in ("ObjStm", "XRef")]:
        del objects[ref]


def _object_stream(stream: Any) -> dict[int, Any]:
    body = Document({}, {}).decoded(stream) if isinstance(stream, Stream) else None
    if body is None:
        return {}
    lexer = Lexer(body)
    heads = [(lexer.value(), lexer.value()) for _ in range(stream.dict["N"])]
    return {n: Lexer(body, stream.dict["First"] + at).value() for n, at in heads}


def _by_scan(data: bytes) -> Document:
    """Without a usable cross-reference: every `n g obj`, the last of each number, and the last trailer."""
    objects: dict[Ref, Any] = {}
    at = 0
    for m in re.finditer(rb"(?<![0-9])\d+[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj", data):
        if m.start() < at:
            continue
        try:
            ref, value = _object_at(data, m.start())
        except (PdfError, ValueError, RecursionError):
            continue
        objects[ref] = value
        if isinstance(value, Stream):
            at = m.end() + len(value.raw)
    if not objects:
        raise PdfError("no objects")
    trailer: dict = {}
    for m in re.finditer(rb"trailer", data):
        v = Lexer(data, m.end()).value()
        trailer |= v if isinstance(v, dict) else {}
    boxes = [v for v in objects.values() if isinstance(v, Stream) and v.dict.get("Type") == "ObjStm"]
    for box in boxes:
        for n, v in _object_stream(box).items():
            objects.setdefault(Ref(n, 0), v)
    for v in list(objects.values()):
        if isinstance(v, Stream) and v.dict.get("Type") == "XRef":
            trailer |= {k: v.dict[k] for k in ("Root", "Info", "Encrypt", "ID") if k in v.dict}
    if "Root" not in trailer:
        roots = [r for r, v in objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        trailer |= {"Root": roots[-1]} if roots else {}
    drop = [r for r, v in objects.items() if isinstance(v, Stream) and v.dict.get("Type") in ("ObjStm", "XRef")]
    return Document({k: v for k, v in objects.items() if k not in drop}, trailer)


# ---- writing -----------------------------------------------------------------------------------------------------

_PLAIN = frozenset(b"!\"$&'*+,-.0123456789:;=?@ABCDEFGHIJKLMNOPQRSTUVWXYZ\\^_`abcdefghijklmnopqrstuvwxyz|~")


def shown(value: Any) -> bytes:
    """A value as PDF syntax; keys in order, so equal values have equal bytes."""
    kind = type(value)
    if kind is int:
        return b"%d" % value
    if kind is Ref:
        return b"%d %d R" % value
    if kind is Name:
        return _shown_name(value)
    if kind is list:
        if set(map(type, value)) == {int}:
            return b"[" + " ".join(map(str, value)).encode() + b"]"
        return b"[" + b" ".join(map(shown, value)) + b"]"
    if kind is dict:
        return b"<<" + b" ".join([_shown_name(k) + b" " + shown(v) for k, v in sorted(value.items())]) + b">>"
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Operator):
        return bytes(value)
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        text = f"{value:.6f}".rstrip("0").rstrip(".")
        return (text if text not in ("-0", "") else "0").encode()
    if isinstance(value, Hex):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, bytes):
        return b"(" + re.sub(rb"([()\\])", rb"\\\1", value).replace(b"\r", b"\\r") + b")"
    raise TypeError(type(value))


def _shown_name(name: str) -> bytes:
    if (known := _shown_names.get(name)) is None:
        known = b"/" + b"".join(bytes([b]) if b in _PLAIN else b"#%02X" % b for b in name.encode("latin-1"))
        if len(_shown_names) < _KEPT_NAMES and len(name) < 128:
            _shown_names[name] = known
    return known


def _body(value: Any) -> bytes:
    if isinstance(value, Stream):
        return shown(value.dict | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    return shown(value)


def write_classic(doc: Document) -> bytes:
    """One cross-reference table."""
    out, at = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % doc.version.encode()), {}
    for ref, value in sorted(doc.objects.items()):
        at[ref.num] = (len(out), ref.gen)
        out += b"%d %d obj\n" % ref + _body(value) + b"\nendobj\n"
    size = max(at, default=0) + 1
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d %05d n \n" % at[n] if n in at else b"0000000000 00000 f \n"
    return bytes(out + b"trailer\n" + shown(doc.trailer | {"Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def write_packed(doc: Document, per_box: int = 200) -> bytes:
    """Object streams and a cross-reference stream: smaller, PDF 1.5."""
    out, rows = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}
    loose = sorted(r for r, v in doc.objects.items() if not isinstance(v, Stream) and r.gen == 0)
    next_num = max((r.num for r in doc.objects), default=0) + 1
    for ref, value in sorted(doc.objects.items()):
        if isinstance(value, Stream) or ref.gen:
            rows[ref.num] = (1, len(out), ref.gen)
            out += b"%d %d obj\n" % ref + _body(value) + b"\nendobj\n"
    for i in range(0, len(loose), per_box):
        part, texts, heads, at = loose[i : i + per_box], [], [], 0
        for k, ref in enumerate(part):
            texts.append(shown(doc.objects[ref]))
            heads.append(b"%d %d" % (ref.num, at))
            at += len(texts[-1]) + 1
            rows[ref.num] = (2, next_num, k)
        head = b" ".join(heads) + b"\n"
        rows[next_num] = (1, len(out), 0)
        box = Stream({"Type": Name("ObjStm"), "N": len(part), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + b" ".join(texts), 9))
        out += b"%d 0 obj\n" % next_num + _body(box) + b"\nendobj\n"
        next_num += 1
    rows[next_num] = (1, len(out), 0)
    wide = max(1, (len(out).bit_length() + 7) // 8)
    table = b"".join(b"".join((k.to_bytes(1, "big"), a.to_bytes(wide, "big"), b.to_bytes(2, "big"))) for k, a, b in (rows.get(n, (0, 0, 65535 if n == 0 else 0)) for n in range(next_num + 1)))
    start = len(out)
    own = doc.trailer | {"Type": Name("XRef"), "Size": next_num + 1, "W": [1, wide, 2], "Filter": Name("FlateDecode")}
    return bytes(out + b"%d 0 obj\n" % next_num + _body(Stream(own, zlib.compress(table, 9))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % start)
