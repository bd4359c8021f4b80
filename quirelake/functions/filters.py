"""Stream filters and predictors. Every decoder is strict: what is malformed or too large gives None, never a part."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Fixed value: bytes that one stream may decode to.
DECODE_CAP = 805_306_368
_SPACE = b"\0\t\n\f\r "
#: Abbreviated filter names of inline images.
SHORT_NAMES = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}


def ascii_hex(data: bytes) -> bytes | None:
    body = data.split(b">", 1)[0].translate(None, _SPACE)
    if re.search(rb"[^0-9A-Fa-f]", body):
        return None
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def ascii85(data: bytes) -> bytes | None:
    body = data.split(b"~>", 1)[0].translate(None, _SPACE)
    out, group = bytearray(), bytearray()
    for c in body:
        if c == 0x7A and not group:  # z stands for four zero bytes, between groups only
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                if (n := _base85(group)) is None:
                    return None
                out += n.to_bytes(4, "big")
                group.clear()
        else:
            return None
    if len(group) == 1:
        return None
    if group:
        kept = len(group) - 1
        if (n := _base85(group + bytes([84] * (5 - len(group))))) is None:
            return None
        out += n.to_bytes(4, "big")[:kept]
    return bytes(out)


def _base85(group: bytes) -> int | None:
    n = 0
    for g in group:
        n = n * 85 + g
    return n if n < 1 << 32 else None


def run_length(data: bytes) -> bytes | None:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n == 128:
            return bytes(out)
        take = n + 1 if n < 128 else 1
        if at + take > len(data):
            return None
        out += data[at : at + take] if n < 128 else data[at : at + 1] * (257 - n)
        at += take
        if len(out) > DECODE_CAP:
            return None
    return bytes(out)


def inflate(data: bytes, cap: int = DECODE_CAP, lenient: bool = False) -> bytes | None:
    """zlib; lenient: then raw deflate after the two header bytes."""
    for wbits, body in ((15, data), (-15, data[2:])) if lenient else ((15, data),):
        try:
            engine = zlib.decompressobj(wbits)
            out = engine.decompress(body, cap + 1)
            if len(out) > cap:
                return None
            if engine.eof:
                return out
        except zlib.error:
            pass
    return None


def predicted(data: bytes, parms: dict) -> bytes | None:
    """Undo /Predictor 2 (TIFF, 8 bits) or 10 to 15 (PNG); rows must fill the data exactly."""
    kind = parms.get("Predictor", 1)
    if kind == 1:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    if not all(isinstance(x, int) and 0 < x < 1 << 24 for x in (colors, bits, columns)):
        return None
    row = (colors * bits * columns + 7) // 8
    step = max(1, colors * bits // 8)
    if kind == 2:
        if bits != 8 or len(data) % row:
            return None
        a = np.frombuffer(data, np.uint8).reshape(-1, columns, colors)
        return np.cumsum(a, axis=1, dtype=np.uint8).tobytes()
    if not 10 <= kind <= 15 or len(data) % (row + 1):
        return None
    lines = np.frombuffer(data, np.uint8).reshape(-1, row + 1)
    above, out = np.zeros(row, np.uint8), np.empty((len(lines), row), np.uint8)
    for i, line in enumerate(lines):
        if (above := _png_row(int(line[0]), line[1:], above, step)) is None:
            return None
        out[i] = above
    return out.tobytes()


def _png_row(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray | None:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1 and len(line) % step == 0:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind not in (1, 3, 4):
        return None
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - step] if i >= step else 0
            p = left + up[i] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def decode(data: bytes, names: list[str], parms: list[dict]) -> bytes | None:
    """Apply a chain of filters; None if any is unknown or fails."""
    for name, own in zip(names, parms + [{}] * len(names), strict=False):
        name = SHORT_NAMES.get(name, name)
        step = {"ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length, "FlateDecode": inflate}.get(name)
        data = step(data) if step and data is not None else None
        if data is not None and name == "FlateDecode":
            data = predicted(data, own)
        if data is None or len(data) > DECODE_CAP:
            return None
    return data
