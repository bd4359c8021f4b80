"""Baseline JPEG in numpy: headers, encoder (gray or 4:2:0), decoder (baseline Huffman)."""

from __future__ import annotations

import struct

import numpy as np

#: The example tables of the JPEG standard (ITU T.81, annex K).
LUMA_Q = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
CHROMA_Q = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32)
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_N = np.arange(8)
_DCT = np.where(_N[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _N[None, :] + 1) * _N[:, None] * np.pi / 16)


def components(data: bytes) -> int | None:
    """Number of components by the frame header."""
    head = frame(data)
    return head[2] if head else None


def frame(data: bytes) -> tuple[int, int, int] | None:
    """(width, height, components)."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 10 > len(data):
                return None
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h, data[at + 9]
        at += 1 if marker == 0xFF else 2 + size
    return None


def _scaled(table: np.ndarray, quality: int) -> np.ndarray:
    quality = min(100, max(1, quality))
    s = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((table * s + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def _padded(plane: np.ndarray, unit: int) -> np.ndarray:
    h, w = plane.shape
    return np.pad(plane, ((0, -h % unit), (0, -w % unit)), mode="edge")


def _lengths_to_codes(freq: np.ndarray) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length (1 to 16), symbols in order, symbol -> (code, length): a canonical Huffman code of these weights."""
    import heapq

    symbols = [int(s) for s in np.flatnonzero(freq)] or [0]
    heap = [(int(max(freq[s], 1)), i, [s]) for i, s in enumerate(symbols)] + [(0, len(symbols), [256])]
    heapq.heapify(heap)
    depth = dict.fromkeys([*symbols, 256], 0)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
    bits = [0] * 64
    for d in depth.values():
        bits[d] += 1
    for i in range(63, 16, -1):  # lengths above 16 move up, pairwise
        while bits[i]:
            j = i - 2
            while not bits[j]:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    last = max(i for i in range(17) if bits[i])
    bits[last] -= 1  # the reserved code of all ones
    order = sorted(symbols, key=lambda s: (depth[s], s))
    codes, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(bits[length]):
            codes[order[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return bits[1:17], order, codes


def _symbols(blocks: np.ndarray) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int, int]]]]:
    """Of quantised blocks in scan order: (size, bits, count) of DC steps, and of each block's AC runs (symbol, bits, count)."""
    dc = np.diff(blocks[:, 0], prepend=0)
    sizes = lambda v: np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(int) + 1)
    extra = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v)
    ds = sizes(dc)
    dcs = list(zip(ds.tolist(), extra(dc, ds).tolist(), ds.tolist(), strict=True))
    s_all = sizes(blocks)
    e_all = extra(blocks, s_all)
    acs = []
    for i in range(len(blocks)):
        at = np.flatnonzero(blocks[i, 1:]) + 1
        row, before = [], 0
        for p in at.tolist():
            run = p - before - 1
            while run > 15:
                row.append((0xF0, 0, 0))
                run -= 16
            size = int(s_all[i, p])
            row.append((run << 4 | size, int(e_all[i, p]), size))
            before = p
        if before < 63:
            row.append((0, 0, 0))
        acs.append(row)
    return dcs, acs


def encode(img: np.ndarray, quality: int) -> bytes | None:
    """Gray stays one component; RGB becomes YCbCr 4:2:0. None if a side is above 65 535 or nothing is there."""
    h, w = img.shape[:2]
    if not (0 < h < 65_536 and 0 < w < 65_536):
        return None
    tables = [_scaled(LUMA_Q, quality), _scaled(CHROMA_Q, quality)]
    if img.ndim == 2:
        planes = [(_padded(img.astype(np.float64), 8), 0)]
    else:
        v = img.astype(np.float64)
        y = 0.299 * v[..., 0] + 0.587 * v[..., 1] + 0.114 * v[..., 2]
        cb, cr = 128 + (v[..., 2] - y) / 1.772, 128 + (v[..., 0] - y) / 1.402
        half = lambda p: _padded(p, 16).reshape(-(-h // 16) * 8, 2, -(-w // 16) * 8, 2).mean(axis=(1, 3))
        planes = [(_padded(y, 16), 0), (half(cb), 1), (half(cr), 1)]
    scans = []
    for plane, t in planes:
        b = _blocks(plane - 128)
        f = np.einsum("ij,abjk,lk->abil", _DCT, b, _DCT)
        q = np.rint(f / tables[t].reshape(8, 8)).astype(int).reshape(*b.shape[:2], 64)[..., ZIGZAG]
        if len(planes) == 3 and t == 0:  # luma in units of two by two blocks
            r, c = q.shape[:2]
            q = q.reshape(r // 2, 2, c // 2, 2, 64).swapaxes(1, 2)
        scans.append((_symbols(q.reshape(-1, 64)), t))
    freq = np.zeros((2, 2, 257), int)  # table, dc or ac, symbol
    for (dcs, acs), t in scans:
        np.add.at(freq[t, 0], [d[0] for d in dcs], 1)
        np.add.at(freq[t, 1], [a[0] for row in acs for a in row], 1)
    used = range(1 if len(planes) == 1 else 2)
    codes = {(t, k): _lengths_to_codes(freq[t, k]) for t in used for k in (0, 1)}
    words: list[tuple[int, int]] = []
    units = len(scans[0][0][0]) // (4 if len(planes) == 3 else 1)
    for u in range(units):
        for (dcs, acs), t in scans:
            per = 4 if len(planes) == 3 and t == 0 else 1
            for i in range(u * per, u * per + per):
                for kind, items in ((0, [dcs[i]]), (1, acs[i])):
                    table = codes[t, kind][2]
                    for symbol, extra, n in items:
                        words.append(table[symbol])
                        if n:
                            words.append((extra, n))
    body = _packed(words)
    out = bytearray(b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0")
    for t in used:
        out += b"\xff\xdb\0\x43" + bytes([t]) + bytes(tables[t][ZIGZAG].tolist())
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(planes), 8, h, w, len(planes))
    for i, (_, t) in enumerate(planes):
        out += bytes([i + 1, 0x22 if len(planes) == 3 and t == 0 else 0x11, t])
    for (t, k), (bits, order, _) in codes.items():
        out += b"\xff\xc4" + struct.pack(">HB", 19 + len(order), k << 4 | t) + bytes(bits) + bytes(order)
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(planes), len(planes))
    for i, (_, t) in enumerate(planes):
        out += bytes([i + 1, t << 4 | t])
    return bytes(out + b"\0\x3f\0" + body.replace(b"\xff", b"\xff\0") + b"\xff\xd9")


def _packed(words: list[tuple[int, int]]) -> bytes:
    if not words:
        return b""
    value, length = np.array(words, np.int64).T
    at = np.cumsum(length) - length
    total = int(length.sum())
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    n = int(length.max())
    for i in range(n):  # bit i of every word, counted from its end
        has = length > i
        bits[at[has] + length[has] - 1 - i] = value[has] >> i & 1
    return np.packbits(bits).tobytes()


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)).tolist() + [1] * 64
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (s := table.get((length, code))) is not None:
                return s
        raise ValueError("bad Huffman code")


def decode(data: bytes) -> np.ndarray | None:
    """Gray, RGB, or CMYK as stored (four channels); None for what is not baseline or is broken."""
    try:
        return _decode(data)
    except (ValueError, IndexError, KeyError, struct.error):
        return None


def _decode(data: bytes) -> np.ndarray | None:
    at, quant, huff, comps, adobe, restart = 2, {}, {}, [], None, 0
    if data[:2] != b"\xff\xd8":
        return None
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide, t = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[t] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(int)
                body = body[1 + n :]
        elif marker in (0xC0, 0xC1):
            _, h, w, n = struct.unpack(">BHHB", body[:6])
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return None
        elif marker == 0xC4:
            while body:
                n, code, k, table = sum(body[1:17]), 0, 17, {}
                for length in range(1, 17):
                    for _ in range(body[length]):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huff[body[0] >> 4, body[0] & 15] = table
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            pick = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            at += 2 + size
            break
        elif marker == 0xD9:
            return None
        at += 2 + size
    end = data.rfind(b"\xff\xd9")
    import re

    parts = re.split(rb"\xff[\xd0-\xd7]", data[at : end if end > at else len(data)])
    hm, vm = max(c[1] for c in comps), max(c[2] for c in comps)
    mw, mh = -(-w // (8 * hm)), -(-h // (8 * vm))
    planes = {c[0]: np.zeros((mh * c[2], mw * c[1], 64), int) for c in comps}
    bits, pred, done = _Bits(parts[0]), dict.fromkeys(planes, 0), 0
    for unit in range(mw * mh):
        if restart and unit and unit % restart == 0:
            done += 1
            bits, pred = _Bits(parts[done]), dict.fromkeys(planes, 0)
        for cid, ch, cv, _ in comps:
            dct, act = (huff[k, pick[cid][k]] for k in (0, 1))
            for v in range(cv):
                for u in range(ch):
                    block = planes[cid][unit // mw * cv + v, unit % mw * ch + u]
                    s = bits.symbol(dct)
                    x = bits.take(s)
                    pred[cid] += x - (1 << s) + 1 if s and x < 1 << (s - 1) else x
                    block[0], k = pred[cid], 1
                    while k < 64:
                        rs = bits.symbol(act)
                        run, s = rs >> 4, rs & 15
                        if not s:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        x = bits.take(s)
                        block[k] = x - (1 << s) + 1 if x < 1 << (s - 1) else x
                        k += 1
    out = []
    for cid, ch, cv, t in comps:
        z = np.zeros_like(planes[cid])
        z[..., ZIGZAG] = planes[cid] * quant[t]
        p = np.einsum("ji,abjk,kl->abil", _DCT, z.reshape(*z.shape[:2], 8, 8).astype(float), _DCT) + 128
        p = p.swapaxes(1, 2).reshape(z.shape[0] * 8, z.shape[1] * 8)
        out.append(p.repeat(vm // cv, 0).repeat(hm // ch, 1)[:h, :w])
    clip = lambda a: np.clip(np.rint(a), 0, 255).astype(np.uint8)
    if len(out) == 1:
        return clip(out[0])
    y, cb, cr = out[0], out[1] - 128, out[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    if len(out) == 3:
        return clip(np.stack(out, axis=-1) if adobe == 0 else rgb)
    return clip(np.concatenate([255 - rgb if adobe == 2 else np.stack(out[:3], axis=-1), out[3][..., None]], axis=-1))
