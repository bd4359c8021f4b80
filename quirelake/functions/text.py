"""Text of a page: fonts, the text state, glyphs with places, and what they say."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache
from math import isfinite
from typing import Any, NamedTuple

import numpy as np

from .content import Operation, Page
from .pdf import Document, Hex, Lexer, Name, Operator, Ref, Stream, _END

#: Advance widths of the printable ASCII codes of Helvetica, from its public metrics (AFM).
HELVETICA = (278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584)
COURIER = 600
#: Glyph names of /Differences that are understood beside single letters.
GLYPH_NAMES = {"space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "equal": "=", "question": "?", "at": "@"}
TOLERANCE, UPRIGHT = 0.01, 1e-3


class Font(NamedTuple):
    """key: what tells fonts apart. reason: why it cannot be measured, else None."""

    key: str
    code_len: int
    widths: dict[int, float]
    default: float
    text: dict[bytes, str]
    reason: str | None


class Glyph(NamedTuple):
    op_index: int
    element: int  # place in a TJ array, 0 elsewhere
    offset: int  # first byte in its string
    code: bytes
    x: float
    y: float
    advance: float  # along the baseline, on the page
    own_advance: float  # in text space, before the horizontal scale is left out
    size: float
    baseline: tuple[float, float]
    ascent: tuple[float, float]
    font: str
    font_key: str
    mode: int
    scale: float
    text: str | None

    @property
    def upright(self) -> bool:
        near = lambda p, q: abs(p[0] - q[0]) <= UPRIGHT and abs(p[1] - q[1]) <= UPRIGHT
        return near(self.baseline, (1, 0)) and near(self.ascent, (0, 1))

    @property
    def probe(self) -> tuple[float, float]:
        """A point inside the glyph: half its advance, 0.3 of its size above the baseline."""
        up = 0.3 * self.size
        return self.x + self.baseline[0] * self.advance / 2 + self.ascent[0] * up, self.y + self.baseline[1] * self.advance / 2 + self.ascent[1] * up


_CODES = tuple(bytes([c]) for c in range(256))


class Run(NamedTuple):
    """One string as shown: what its glyphs have in common. tm: the text matrix at its first glyph."""

    op_index: int
    element: int
    offset: int
    codes: bytes
    tm: tuple
    ctm: tuple
    font: str
    of: Font
    size: float
    char: float
    word: float
    scale: float
    rise: float
    mode: int

    def parts(self) -> list[bytes]:
        """The code of each glyph."""
        n = self.of.code_len
        return [_CODES[c] for c in self.codes] if n == 1 else [self.codes[k : k + n] for k in range(0, len(self.codes), n)]

    def own(self) -> np.ndarray:
        """Each glyph's advance in text space."""
        font, n = self.of, self.of.code_len
        if n == 1:
            at = np.frombuffer(self.codes, np.uint8)
            wide, spaces = wide_table(font)[at], at == 32
        else:
            wide = np.array([font.widths.get(int.from_bytes(self.codes[i : i + n], "big"), font.default) for i in range(0, len(self.codes), n)], np.float64)
            spaces = False
        with np.errstate(all="ignore"):
            return (wide / 1000 * self.size + self.char + np.where(spaces, self.word, 0.0)) * self.scale

    def end(self) -> tuple:
        """The text matrix after its last glyph."""
        a, b, c, d, e, f = self.tm
        own = self.own()
        with np.errstate(all="ignore"):
            return (a, b, c, d, float(np.cumsum(np.concatenate(([e], own * a + 0.0 * c)))[-1]), float(np.cumsum(np.concatenate(([f], own * b + 0.0 * d)))[-1]))


def wide_table(font: Font) -> np.ndarray:
    """Widths by single-byte code."""
    out = np.full(256, font.default, np.float64)
    keys = [k for k in font.widths if 0 <= k < 256]
    out[keys] = [font.widths[k] for k in keys]
    return out


class _Columns(dict):
    """Columns by glyph; what all glyphs of a run share is spread out when asked for."""

    def __init__(self, measured) -> None:
        own, self.of, self.lengths = measured()
        super().__init__(own)

    def __missing__(self, key: str) -> np.ndarray:
        self[key] = np.repeat(self.of[key], self.lengths)
        return self[key]


class PageText:
    """Strings shown, in order; glyphs and their places are worked out when asked for, all strings of a state at once."""

    def __init__(self) -> None:
        self.runs: list[Run] = []
        self.unsupported: list[tuple[int, str]] = []  # operation, reason
        self._columns: dict[str, np.ndarray] | None = None

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(r.codes) // r.of.code_len for r in self.runs], np.int64)

    def columns(self) -> dict[str, np.ndarray]:
        """By glyph: run (its place), x, y, advance, own, size, upright, and the parts of baseline and ascent (bx, by, ax, ay)."""
        if self._columns is None:
            self._columns = _Columns(self._measured)
        return self._columns

    def _measured(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
        """Columns by glyph, columns by run, and glyphs of each run."""
        lengths = self.lengths
        total, starts = int(lengths.sum()), np.concatenate(([0], np.cumsum(lengths)))[:-1]
        out = {k: np.empty(total, np.float64) for k in ("x", "y", "advance", "own")}
        of = {k: np.empty(len(self.runs), np.float64) for k in ("size", "bx", "by", "ax", "ay")}
        alike: dict[tuple, list[int]] = {}
        for i, r in enumerate(self.runs):
            alike.setdefault((r.tm[:4], r.ctm, id(r.of), r.size, r.char, r.word, r.scale, r.rise), []).append(i)
        with np.errstate(all="ignore"):
            for members in alike.values():
                n = lengths[members]
                # runs of a state lie in the rows of a matrix, unless one is much longer than the others
                groups = [members] if int(n.max()) * len(members) <= 4 * int(n.sum()) + 65_536 else [[m] for m in members]
                for group in groups:
                    self._measure(group, lengths[group], starts[group], out, of)
        near = lambda k, v: np.abs(of[k] - v) <= UPRIGHT
        of["upright"] = near("bx", 1) & near("by", 0) & near("ax", 0) & near("ay", 1)
        of["run"] = np.arange(len(self.runs))
        return out, of, lengths

    def _measure(self, group: list[int], n: np.ndarray, starts: np.ndarray, out: dict, of: dict) -> None:
        """Places of the glyphs of runs that share all but text and start. Sums go from left to right, as glyphs do."""
        r = self.runs[group[0]]
        a, b, c, d = r.tm[:4]
        along, up = (_times(r.tm, r.ctm)[:2], _times(_times((r.size * r.scale, 0, 0, r.size, 0, r.rise), r.tm), r.ctm)[2:4])
        wide, high = (along[0] ** 2 + along[1] ** 2) ** 0.5, (up[0] ** 2 + up[1] ** 2) ** 0.5
        unit = lambda p, n: (p[0] / n, p[1] / n) if n else (0.0, 0.0)
        for k, v in zip(("size", "bx", "by", "ax", "ay"), (high, *unit(along, wide), *unit(up, high)), strict=True):
            of[k][group] = v
        own = np.concatenate([self.runs[i].own() for i in group]) if r.of.code_len > 1 else r._replace(codes=b"".join([self.runs[i].codes for i in group])).own()
        rows, most = len(group), int(n.max())
        inside = np.arange(most) < n[:, None]
        steps = np.zeros((rows, most + 1))
        steps[:, 1:][inside] = own * a + 0.0 * c
        steps[:, 0] = [self.runs[i].tm[4] for i in group]
        e = np.cumsum(steps, axis=1)[:, :-1][inside]
        rise = own * b + 0.0 * d
        f = np.repeat([self.runs[i].tm[5] for i in group], n)
        if rise.any():  # a level line adds nothing
            steps[:, 1:][inside] = rise
            steps[:, 0] = [self.runs[i].tm[5] for i in group]
            f = np.cumsum(steps, axis=1)[:, :-1][inside]
        g, h, i, j, k, l = r.ctm  # noqa: E741
        e, f = (0 * a + r.rise * c) + e, (0 * b + r.rise * d) + f
        at = slice(0, len(own)) if rows == len(self.runs) else np.repeat(starts - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(len(own))
        out["x"][at], out["y"][at] = e * g + f * i + k, e * h + f * j + l
        out["own"][at], out["advance"][at] = own, own * wide

    def codes(self) -> list[bytes]:
        return [c for r in self.runs for c in r.parts()]

    def said(self) -> list[str | None]:
        """What each glyph says."""
        out: list[str | None] = []
        for r in self.runs:
            known = r.of.text
            says = {c: known.get(_CODES[c]) for c in set(r.codes)} if r.of.code_len == 1 else {c: known.get(c) for c in set(r.parts())}
            out += map(says.__getitem__, r.codes if r.of.code_len == 1 else r.parts())
        return out

    def said_whole(self) -> str:
        """What the page's glyphs say together; those that say nothing are left out."""
        return "".join([t for t in self.said() if t is not None])

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """A point inside each glyph: half its advance, 0.3 of its size above the baseline."""
        c = self.columns()
        up = 0.3 * c["size"]
        return c["x"] + c["bx"] * c["advance"] / 2 + c["ax"] * up, c["y"] + c["by"] * c["advance"] / 2 + c["ay"] * up

    def glyphs_of(self, runs: range | list[int]) -> list[Glyph]:
        """The glyphs of these runs."""
        c, out = self.columns(), []
        ends = np.cumsum(self.lengths)
        for k in runs:
            r, n = self.runs[k], self.runs[k].of.code_len
            last, first = int(ends[k]), int(ends[k]) - len(self.runs[k].codes) // self.runs[k].of.code_len
            if first == last:
                continue
            size, base, ascent = float(c["size"][first]), (float(c["bx"][first]), float(c["by"][first])), (float(c["ax"][first]), float(c["ay"][first]))
            rows = zip(range(0, len(r.codes), n), *(c[v][first:last].tolist() for v in ("x", "y", "advance", "own")), strict=True)
            out += [Glyph(r.op_index, r.element, r.offset + at, code := r.codes[at : at + n], x, y, advance, own, size, base, ascent, r.font, r.of.key, r.mode, r.size * r.scale, r.of.text.get(code)) for at, x, y, advance, own in rows]
        return out

    @property
    def glyphs(self) -> list[Glyph]:
        return self.glyphs_of(range(len(self.runs)))


@lru_cache(maxsize=8)
def _base_text(codec: str | None) -> dict[bytes, str]:
    """Single-byte codes to text under an encoding; without one, printable ASCII."""
    out: dict[bytes, str] = {}
    for c in range(256):
        t = bytes([c]).decode(codec, "ignore") if codec else chr(c) if 0x20 <= c < 0x7F else ""
        if t:
            out[bytes([c])] = t
    return out


def simple_text(doc: Document, font: dict) -> dict[bytes, str]:
    """Single-byte codes to text: the base encoding, then /Differences."""
    encoding = doc.get(font.get("Encoding"))
    own = encoding if isinstance(encoding, dict) else {}
    base = encoding if isinstance(encoding, Name) else doc.get(own.get("BaseEncoding"))
    codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(base or "")
    out = dict(_base_text(codec))
    at = 0
    for item in doc.get(own.get("Differences")) or []:
        item = doc.get(item)
        if isinstance(item, int):
            at = item
        elif isinstance(item, Name):
            t = item if len(item) == 1 else GLYPH_NAMES.get(item)
            out.pop(bytes([at & 255]), None)
            if t:
                out[bytes([at & 255])] = str(t)
            at += 1
    return out


def to_unicode(data: bytes) -> dict[bytes, str]:
    """A ToUnicode CMap: bfchar, and bfrange with an array or a first value that counts up."""
    out: dict[bytes, str] = {}
    lexer, stack, mode = Lexer(data, refs=False), [], None
    wide = lambda b: bytes(b).decode("utf-16-be", "ignore")
    while (v := lexer.value()) is not _END:
        if isinstance(v, Operator):
            if v in (b"beginbfchar", b"beginbfrange"):
                mode, stack = v, []
            elif v == b"endbfchar" and mode == b"beginbfchar":
                for code, t in zip(stack[::2], stack[1::2], strict=False):
                    if isinstance(code, bytes) and isinstance(t, bytes):
                        out[bytes(code)] = wide(t)
            elif v == b"endbfrange" and mode == b"beginbfrange":
                for low, high, t in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    out |= _range(low, high, t, wide)
        else:
            stack.append(v)
    return out


def _range(low: Any, high: Any, t: Any, wide) -> dict[bytes, str]:
    if not (isinstance(low, bytes) and isinstance(high, bytes) and len(low) == len(high)):
        return {}
    first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
    out = {}
    for i in range(min(last - first + 1, 65_536)):
        code = (first + i).to_bytes(len(low), "big")
        if isinstance(t, list):
            if i < len(t) and isinstance(t[i], bytes):
                out[code] = wide(t[i])
        elif isinstance(t, bytes) and (w := wide(t)):
            if ord(w[-1]) + i <= 0x10FFFF:
                out[code] = w[:-1] + chr(ord(w[-1]) + i)
    return out


def font_of(doc: Document, value: Any, owner: str) -> Font:
    font = doc.dict_of(value)
    key = f"{value.num} {value.gen}" if isinstance(value, Ref) else owner
    mapped = doc.get(font.get("ToUnicode"))
    text = to_unicode(body) if isinstance(mapped, Stream) and (body := doc.decoded(mapped)) is not None else None
    kind = doc.get(font.get("Subtype"))
    number = lambda x, d: float(v) if isinstance(v := doc.get(x), (int, float)) and not isinstance(v, bool) else d
    if kind == "Type0":
        if doc.get(font.get("Encoding")) != "Identity-H":
            return Font(key, 2, {}, 0, text or {}, "unsupported_encoding")
        down = doc.dict_of((doc.get(font.get("DescendantFonts")) or [None])[0])
        return Font(key, 2, _cid_widths(doc, doc.get(down.get("W")) or []), number(down.get("DW"), 1000.0), text or {}, None)
    text = simple_text(doc, font) if text is None else text
    if kind not in ("Type1", "TrueType", "MMType1"):
        return Font(key, 1, {}, 0, text, "unsupported_font")
    widths, first = doc.get(font.get("Widths")), doc.get(font.get("FirstChar"))
    missing = number(doc.dict_of(font.get("FontDescriptor")).get("MissingWidth"), 0.0)
    if isinstance(widths, list) and isinstance(first, int):
        plain = all(type(w) is int or type(w) is float for w in widths)
        return Font(key, 1, dict(zip(range(first, first + len(widths)), map(float, widths) if plain else [number(w, missing) for w in widths], strict=True)), missing, text, None)
    base = str(doc.get(font.get("BaseFont")))
    if base.startswith("Courier"):
        return Font(key, 1, {}, COURIER, text, None)
    if base in ("Helvetica", "Helvetica-Oblique", "Arial"):
        return Font(key, 1, {32 + i: float(w) for i, w in enumerate(HELVETICA)}, 0.0, text, None)
    return Font(key, 1, {}, 0, text, "no_widths")


def _cid_widths(doc: Document, rows: list) -> dict[int, float]:
    out, i = {}, 0
    rows = [doc.get(r) for r in rows]
    while i + 1 < len(rows):
        if isinstance(rows[i + 1], list):
            out |= {rows[i] + k: float(doc.get(w)) for k, w in enumerate(rows[i + 1])}
            i += 2
        elif i + 2 < len(rows):
            out |= dict.fromkeys(range(rows[i], min(rows[i + 1], 65_535) + 1), float(rows[i + 2]))
            i += 3
        else:
            break
    return out


def page_fonts(doc: Document, page: Page) -> dict[str, Font]:
    fonts = doc.dict_of(doc.dict_of(page.inherited.get("Resources")).get("Font"))
    return {k: font_of(doc, v, f"{page.ref.num}/{k}") for k, v in fonts.items()}


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


@dataclass
class _State:
    ctm: tuple = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    font: str | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


class Interpreter:
    """The text state of one page, operation by operation."""

    def __init__(self, fonts: dict[str, Font], forms: set[str] = frozenset()):
        self.fonts, self.forms, self.out = fonts, forms, PageText()
        self.now, self.stack, self.tm, self.line, self.known = _State(), [], None, None, True

    def run(self, ops: list[Operation]) -> PageText:
        for i, op in enumerate(ops):
            try:
                self.step(i, op.operator, op.operands)
            except (IndexError, TypeError, ValueError):
                self.lost(i, "malformed")
        return self.out

    def lost(self, i: int, why: str) -> None:
        self.out.unsupported.append((i, why))
        self.known = False

    def step(self, i: int, name: str, v: list) -> None:
        s = self.now
        if name == "q":
            self.stack.append(replace(s))
        elif name == "Q":
            self.now = self.stack.pop() if self.stack else s
        elif name == "cm":
            s.ctm = _times(tuple(map(float, v[:6])), s.ctm)
        elif name == "BT":
            self.tm = self.line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            self.known = True
        elif name == "ET":
            self.tm = None
        elif name == "Tf":
            s.font, s.size = str(v[0]), float(v[1])
        elif name in ("Tc", "Tw", "TL", "Ts"):
            setattr(s, {"Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise"}[name], float(v[0]))
        elif name == "Tz":
            s.scale = float(v[0]) / 100
        elif name == "Tr":
            s.mode = int(v[0])
        elif name == "Tm":
            self.tm = self.line = tuple(map(float, v[:6]))
            self.known = True
        elif name in ("Td", "TD"):
            if name == "TD":
                s.leading = -float(v[1])
            self.move(float(v[0]), float(v[1]))
        elif name == "T*":
            self.move(0, -s.leading)
        elif name == "Tj":
            self.show(i, 0, v[0])
        elif name in ("'", '"'):
            if name == '"':
                s.word, s.char = float(v[0]), float(v[1])
            self.move(0, -s.leading)
            self.show(i, 0, v[-1])
        elif name == "TJ":
            for k, x in enumerate(v[0]):
                if isinstance(x, bytes):
                    self.show(i, k, x)
                elif self.tm:
                    self.tm = _times((1, 0, 0, 1, -float(x) / 1000 * s.size * s.scale, 0), self.here())
        elif name == "Do" and v and str(v[0]) in self.forms:
            self.out.unsupported.append((i, "form_xobject"))

    def move(self, x: float, y: float) -> None:
        if self.line:
            self.tm = self.line = _times((1, 0, 0, 1, x, y), self.line)
            self.known = True

    def show(self, i: int, element: int, text: Any) -> None:
        s, font = self.now, self.fonts.get(self.now.font or "")
        if not isinstance(text, bytes) or self.tm is None:
            return self.lost(i, "malformed")
        if font is None or font.reason:
            return self.lost(i, font.reason if font else "missing_font")
        if not self.known:
            return self.lost(i, "unknown_position")
        if len(text) % font.code_len:
            return self.lost(i, "odd_length")
        if not text:
            return
        tm = self.here()
        numbers = (*tm, *s.ctm, s.size, s.char, s.word, s.scale, s.rise)
        if all(map(isfinite, numbers)):
            self.out.runs.append(Run(i, element, 0, bytes(text), tm, s.ctm, s.font, font, s.size, s.char, s.word, s.scale, s.rise, s.mode))
            self.tm = self.out.runs[-1]
            return
        for at in range(0, len(text), font.code_len):  # what is not finite spreads: glyph by glyph
            run = Run(i, element, at, bytes(text[at : at + font.code_len]), tm, s.ctm, s.font, font, s.size, s.char, s.word, s.scale, s.rise, s.mode)
            self.out.runs.append(run)
            tm = _times((1, 0, 0, 1, float(run.own()[0]), 0), tm)
        self.tm = tm

    def here(self) -> tuple:
        """The text matrix; after a string it is worked out only when something follows on the line."""
        if isinstance(self.tm, Run):
            self.tm = self.tm.end()
        return self.tm


def form_names(doc: Document, page: Page) -> set[str]:
    names = doc.dict_of(doc.dict_of(page.inherited.get("Resources")).get("XObject"))
    return {k for k, v in names.items() if doc.dict_of(v).get("Subtype") == "Form"}


def interpret(doc: Document, page: Page, ops: list[Operation]) -> PageText:
    return Interpreter(page_fonts(doc, page), form_names(doc, page)).run(ops)


def without(ops: list[Operation], seen: PageText, gone: set[int]) -> list[Operation]:
    """The operations without the glyphs of these places; what follows on the line does not move."""
    by_string: dict[tuple[int, int], list[int]] = {}
    run = seen.columns()["run"]
    touched = {seen.runs[r].op_index for r in np.unique(run[sorted(gone)]).tolist()}
    starts = np.concatenate(([0], np.cumsum(seen.lengths)))
    glyphs: dict[int, Glyph] = {}
    for r in [k for k, own in enumerate(seen.runs) if own.op_index in touched]:
        for k, g in enumerate(seen.glyphs_of([r]), int(starts[r])):
            glyphs[k] = g
            by_string.setdefault((g.op_index, g.element), []).append(k)
    out: list[Operation] = []
    for i, op in enumerate(ops):
        if i not in touched:
            out.append(op)
            continue
        items = op.operands[0] if op.operator == "TJ" else [op.operands[-1]]
        row: list = []
        for e, item in enumerate(items):
            if not isinstance(item, bytes):
                row.append(item)
                continue
            run, shift = b"", 0.0
            for k in by_string.get((i, e), []):
                g = glyphs[k]
                if k in gone:
                    if run:
                        row.append(Hex(run) if isinstance(item, Hex) else run)
                        run = b""
                    shift -= g.own_advance * 1000 / g.scale if g.scale else 0.0
                else:
                    if shift:
                        row.append(round(shift, 6))
                        shift = 0.0
                    run += g.code
            if shift:
                row.append(round(shift, 6))
            if run:
                row.append(Hex(run) if isinstance(item, Hex) else run)
        if op.operator == '"':
            out += [Operation("Tw", [op.operands[0]]), Operation("Tc", [op.operands[1]])]
        if op.operator in ("'", '"'):
            out.append(Operation("T*", []))
        out.append(Operation("TJ", [row]))
    return out


def same_rest(before: PageText, gone: set[int], after: PageText, new: range = range(0)) -> bool:
    """Whether the glyphs that stay are drawn as before. new: places in `after` that need no counterpart."""
    kept, there = np.ones(int(before.lengths.sum()), bool), np.ones(int(after.lengths.sum()), bool)
    kept[sorted(gone)] = False
    there[new.start : new.stop] = False
    if int(kept.sum()) != int(there.sum()):
        return False
    a, b = before.columns(), after.columns()
    if not all((np.abs(a[k][kept] - b[k][there]) <= TOLERANCE).all() for k in ("x", "y")):
        return False
    kinds: dict[tuple, int] = {}
    kind = lambda t: np.array([kinds.setdefault((r.of.key, r.mode, r.of.code_len), len(kinds)) for r in t.runs], np.int64)[t.columns()["run"]]
    if not (kind(before)[kept] == kind(after)[there]).all():
        return False
    left = lambda t, mask: [c for c, stays in zip(t.codes(), mask.tolist(), strict=True) if stays]
    return left(before, kept) == left(after, there)


def written(ops: list[Operation]) -> bytes:
    from .pdf import shown

    out = []
    for op in ops:
        if op.operator == "BI":
            values, data = op.operands
            out.append(b"BI " + b" ".join(shown(Name(k)) + b" " + shown(v) for k, v in values.items()) + b" ID " + data + b" EI")
        else:
            out.append(b" ".join([*map(shown, op.operands), op.operator.encode("latin-1")]))
    return b"\n".join(out)


_REGION = re.compile(r"(?:(?P<id>[^@]+)@)?(?P<page>\d+):(?P<box>.+)")


def parse_region(text: str, place: int) -> tuple[str, int, float, float, float, float]:
    """`[id@]page:x,y,w,h` with pages from 1; ValueError if malformed."""
    m = _REGION.fullmatch(text.strip())
    box = [float(x) for x in m["box"].split(",")] if m else []
    if not m or len(box) != 4 or int(m["page"]) < 1:
        raise ValueError(f"not a region: {text!r}")
    return (m["id"] or f"r{place + 1}", int(m["page"]) - 1, *box)
