"""Matrices and placements in single precision, as thresholds on them are hard."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .content import Operation

f32 = np.float32
IDENTITY = tuple(map(f32, (1, 0, 0, 1, 0, 0)))


def times(m: tuple, n: tuple) -> tuple:
    """Apply m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


def matrix_of(operands: list) -> tuple | None:
    if len(operands) == 6 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in operands):
        return tuple(map(f32, operands))
    return None


class Placement(NamedTuple):
    op_index: int
    name: str
    ctm: tuple


def placements(ops: list[Operation]) -> list[Placement]:
    """Where each `Do` paints: q saves, Q restores (nothing when nothing is saved), cm applies before."""
    out, stack, now = [], [], IDENTITY
    with np.errstate(all="ignore"):
        for i, op in enumerate(ops):
            if op.operator == "q":
                stack.append(now)
            elif op.operator == "Q":
                now = stack.pop() if stack else now
            elif op.operator == "cm" and (m := matrix_of(op.operands)):
                now = times(m, now)
            elif op.operator == "Do" and op.operands and isinstance(op.operands[0], str):
                out.append(Placement(i, str(op.operands[0]), now))
    return out


def flatten_matrix(bbox: list, matrix: tuple, rect: list) -> tuple:
    """Scale and move the box of `bbox` under `matrix` to `rect`; a side without extent keeps scale 1."""
    x0, x1 = sorted((bbox[0], bbox[2]))
    y0, y1 = sorted((bbox[1], bbox[3]))
    a, b, c, d, e, f = matrix
    corners = [(a * x + c * y + e, b * x + d * y + f) for x in (x0, x1) for y in (y0, y1)]
    left, low = min(p[0] for p in corners), min(p[1] for p in corners)
    width, height = max(p[0] for p in corners) - left, max(p[1] for p in corners) - low
    rx, ry = min(rect[0], rect[2]), min(rect[1], rect[3])
    sx = abs(rect[2] - rect[0]) / width if width > 0 else 1.0
    sy = abs(rect[3] - rect[1]) / height if height > 0 else 1.0
    return (sx, 0.0, 0.0, sy, rx - left * sx, ry - low * sy)
