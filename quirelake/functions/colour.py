"""Colour spaces and pixels: interpretation, conversion, classification, resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the photo test: distinct 5-bit colours, samples, grain share, side, and the step that counts as grain.
PHOTO_COLOURS, SAMPLES, GRAIN, GRAIN_SIDE, GRAIN_STEP = 4096, 200_000, 0.20, 400, (2, 32)


def gray_column(r: Column, g: Column, b: Column) -> Column:
    return F.floor((30 * r + 59 * g + 11 * b + 50) / 100)


def cmyk_column(c: Column, k: Column) -> Column:
    return F.floor(((255 - c) * (255 - k) + 127) / 255)


def to_gray(rgb: np.ndarray) -> np.ndarray:
    v = rgb.astype(np.uint32)
    return ((30 * v[..., 0] + 59 * v[..., 1] + 11 * v[..., 2] + 50) // 100).astype(np.uint8)


def from_cmyk(cmyk: np.ndarray, adobe: bool = False) -> np.ndarray:
    """adobe: values of an inverted Adobe JPEG."""
    v = cmyk.astype(np.uint32)
    if adobe:
        return (v[..., :3] * v[..., 3:] // 255).astype(np.uint8)
    return (((255 - v[..., :3]) * (255 - v[..., 3:]) + 127) // 255).astype(np.uint8)


def from_indexed(index: np.ndarray, palette: bytes, base: int, hival: int) -> np.ndarray | None:
    """Entries of the palette; None if an index is above the highest or the palette has another length."""
    if len(palette) != (hival + 1) * base or index.max(initial=0) > hival:
        return None
    return np.frombuffer(palette, np.uint8).reshape(-1, base)[index]


def from_raw(data: bytes, width: int, height: int, channels: int, palette: tuple[bytes, int] | None = None) -> np.ndarray | None:
    """(height, width) gray or (height, width, 3) RGB from 8-bit samples; None unless the length fits."""
    per = 1 if palette else channels
    if len(data) != width * height * per:
        return None
    a = np.frombuffer(data, np.uint8).reshape(height, width, per)
    if palette:
        a = from_indexed(a[..., 0], palette[0], channels, palette[1])
        if a is None:
            return None
    if a.shape[-1] == 4:
        return from_cmyk(a)
    return a[..., 0] if a.shape[-1] == 1 else a


def is_photo(img: np.ndarray) -> bool:
    """Many colours, or the grain of a scan."""
    rgb = img if img.ndim == 3 else np.repeat(img[..., None], 3, axis=-1)
    flat = rgb.reshape(-1, 3)
    five = flat[:: max(1, len(flat) // SAMPLES)].astype(np.uint32) >> 3
    if len(np.unique(five[:, 0] << 10 | five[:, 1] << 5 | five[:, 2])) > PHOTO_COLOURS:
        return True
    if min(img.shape[:2]) < GRAIN_SIDE:
        return False
    v = rgb.astype(np.int32)
    luma = (77 * v[..., 0] + 151 * v[..., 1] + 28 * v[..., 2]) >> 8
    step = np.abs(np.diff(luma, axis=1))
    return float(((step >= GRAIN_STEP[0]) & (step < GRAIN_STEP[1])).mean()) >= GRAIN


def _weights(src: int, dst: int, lobes: float = 3.0) -> np.ndarray:
    """(dst, src) weights of a Lanczos kernel, widened when shrinking."""
    scale = max(1.0, src / dst)
    centre = (np.arange(dst) + 0.5) * src / dst - 0.5
    x = (np.arange(src)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(img: np.ndarray, width: int, height: int) -> np.ndarray:
    v = img.astype(np.float64)
    v = np.tensordot(_weights(img.shape[0], height), v, (1, 0))
    v = np.moveaxis(np.tensordot(_weights(img.shape[1], width), v, (1, 1)), 0, 1)
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    mse = float(((a.astype(np.float64) - b) ** 2).mean())
    return float("inf") if mse == 0 else 10 * float(np.log10(255**2 / mse))
