"""Pixel sums of one decoded image.

Each helper reduces an array of pixels to a few numbers, band by band; everything decided from those
numbers is a Spark expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from shoebox.operators.features import HASH_COLS, HASH_ROWS, HUE_BINS, HUE_RANGE, SATURATION_BINS, SATURATION_RANGE
from shoebox.operators.quality import GRID


# Pixels handled at a time, so that the working arrays stay small however large the picture is.
BAND = 1 << 18


def _bands(height: int, width: int, step: int = 1) -> Iterator[tuple[int, int]]:
    """First and last row of bands of about BAND pixels, of a multiple of ``step`` rows."""
    rows = max(1, BAND // max(1, width * step)) * step
    for top in range(0, height, rows):
        yield top, min(height, top + rows)


def gray_of(bgr: np.ndarray) -> np.ndarray:
    """Gray levels of BGR, BGRA or single-channel pixels."""
    if bgr.shape[2] == 1:
        return bgr[:, :, 0]
    out = np.empty(bgr.shape[:2], np.uint8)
    for top, end in _bands(*bgr.shape[:2]):
        b, g, r = (bgr[top:end, :, i].astype(np.int32) for i in range(3))
        out[top:end] = (r * 299 + g * 587 + b * 114 + 500) // 1000
    return out


def laplacian_sums(gray: np.ndarray) -> tuple[int, int]:
    """Sum and sum of squares of the four-neighbour Laplacian, borders mirrored."""
    h, w = gray.shape
    mirror = lambda i, n: 0 if n == 1 else 1 if i < 0 else n - 2 if i >= n else i
    total = squares = 0
    for top, end in _bands(h, w):
        here = gray[top:end].astype(np.int32)
        above = np.concatenate([gray[mirror(top - 1, h)][None], gray[top : end - 1]]).astype(np.int32)
        below = np.concatenate([gray[top + 1 : end], gray[mirror(end, h)][None]]).astype(np.int32)
        left = np.concatenate([here[:, mirror(-1, w)][:, None], here[:, :-1]], axis=1)
        right = np.concatenate([here[:, 1:], here[:, mirror(w, w)][:, None]], axis=1)
        lap = above + below + left + right - 4 * here
        total += int(lap.sum(dtype=np.int64))
        squares += int(np.square(lap, dtype=np.int64).sum())
    return total, squares


def _count(levels: np.ndarray) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for top, end in _bands(*levels.shape):
        out += np.bincount(levels[top:end].ravel(), minlength=256)
    return out


def level_counts(gray: np.ndarray) -> np.ndarray:
    """Level histograms of the whole image (first) and of the grid cells, 256 levels each."""
    ch, cw = gray.shape[0] // GRID, gray.shape[1] // GRID
    out = [_count(gray)]
    for k in range(GRID * GRID):
        y, x = (k // GRID) * ch, (k % GRID) * cw
        out.append(_count(gray[y : y + ch, x : x + cw]))
    return np.concatenate(out)


def _overlap(size: int, cells: int) -> np.ndarray:
    """Overlap of every target cell with every source line, in 1/(size*cells) of the edge."""
    line, cell = np.arange(size), np.arange(cells)[:, None]
    return np.clip(np.minimum((line + 1) * cells, (cell + 1) * size) - np.maximum(line * cells, cell * size), 0, None)


def shrunken(gray: np.ndarray) -> np.ndarray:
    """Area-averaged 9x8 levels, row by row."""
    h, w = gray.shape
    down, across = _overlap(h, HASH_ROWS), _overlap(w, HASH_COLS).T
    total = np.zeros((HASH_ROWS, HASH_COLS), np.int64)
    for top, end in _bands(h, w):
        total += down[:, top:end] @ (gray[top:end].astype(np.int64) @ across)
    return ((2 * total + h * w) // (2 * h * w)).ravel()


def colour_bins(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty hue/saturation bins with their counts."""
    out = np.zeros(HUE_BINS * SATURATION_BINS, np.int64)
    for top, end in _bands(*bgr.shape[:2]):
        planes = [bgr[top:end, :, min(i, bgr.shape[2] - 1)].astype(np.int32).ravel() for i in range(3)]
        b, g, r = planes if bgr.shape[2] > 1 else [planes[0]] * 3
        most = np.maximum(np.maximum(r, g), b)
        span = most - np.minimum(np.minimum(r, g), b)
        safe = np.maximum(span, 1)
        is_r, is_g = most == r, most == g
        first = np.where(is_r, g - b, np.where(is_g, b - r, r - g))
        shift = np.where(is_r, 0, np.where(is_g, 60, 120))
        hue = np.where(span == 0, 0, ((60 * first + span) // (2 * safe) + shift) % HUE_RANGE)
        bright = np.maximum(most, 1)
        saturation = np.where(most == 0, 0, (510 * span + bright) // (2 * bright))
        number = (hue * HUE_BINS // HUE_RANGE) * SATURATION_BINS + saturation * SATURATION_BINS // SATURATION_RANGE
        out += np.bincount(number, minlength=len(out))
    bins = np.flatnonzero(out)
    return bins, out[bins]


def flat_blocks(gray: np.ndarray, side: int) -> tuple[int, int]:
    """Square blocks of one single level, and all blocks."""
    flat = every = 0
    for top, end in _bands(*gray.shape, side):
        rows, columns = np.arange(0, end - top, side), np.arange(0, gray.shape[1], side)
        least = np.minimum.reduceat(np.minimum.reduceat(gray[top:end], rows, axis=0), columns, axis=1)
        most = np.maximum.reduceat(np.maximum.reduceat(gray[top:end], rows, axis=0), columns, axis=1)
        flat += int((least == most).sum())
        every += least.size
    return flat, every


def straight_lines(gray: np.ndarray, step: int, share: float) -> tuple[int, int]:
    """Borders between rows and between columns that are edges over ``share`` of their length, and all borders."""
    h, w = gray.shape
    straight, down = 0, np.zeros(max(0, w - 1), np.int64)
    for top, end in _bands(h, w):
        here = gray[top : min(h, end + 1)].astype(np.int16)
        across = (np.abs(np.diff(here, axis=0)) >= step).sum(axis=1)
        straight += int((across / w >= share).sum())
        down += (np.abs(np.diff(here[: end - top], axis=1)) >= step).sum(axis=0)
    return straight + int((down / h >= share).sum()), h - 1 + w - 1


def bilinear(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize with pixel-centre mapping."""
    h, w = pixels.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    out = np.empty((height, width, pixels.shape[2]), np.uint8)
    for start, end in _bands(height, max(w, width)):
        # Only the source rows that this band mixes.
        upper, lower, mix = pixels[y0[start:end]].astype(np.float64), pixels[y1[start:end]].astype(np.float64), fy[start:end]
        top = upper[:, x0] * (1 - fx) + upper[:, x1] * fx
        low = lower[:, x0] * (1 - fx) + lower[:, x1] * fx
        out[start:end] = np.floor(top * (1 - mix) + low * mix + 0.5)
    return out
