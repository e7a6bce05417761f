"""Words, word hashes and shingles of Arrow text columns, computed on whole batches with numpy.

A word is a run of digits, letters a-z and bytes from 0x80 up, after A-Z are lower-cased.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_SYMBOL = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and where each text begins (one more entry than texts)."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of text, so that memory does not follow text length."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for start, stop in zip(cuts, cuts[1:]):
        if stop > start:
            yield batch.slice(start, stop - start)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, BATCH_BYTES), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true entries; no run crosses the start of a text."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = bounds[:-1][bounds[:-1] < len(inside)]
    first[starts] = inside[starts]
    ends = bounds[1:][bounds[1:] > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``symbols``, the same wherever the run stands."""
    n = len(symbols)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * powers(_STEP, n), dtype=np.uint64, out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(_BACK, n)[starts] if n else total[:0])


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin."""
    low = _LOWER[raw]
    starts, ends = runs(_IN_WORD[low], bounds)
    return run_hashes(_SYMBOL[low], starts, ends), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words; a shorter text with any words is one shingle."""
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(len(words))
    total = np.zeros(len(words), np.uint64)
    for j in range(min(width, len(words))):
        factor = np.uint64(pow(_STEP, j + 2, 1 << 64) | 1)
        shifted = np.zeros_like(words)
        shifted[: len(words) - j] = words[j:]
        total += np.where(left > j, shifted * factor, np.uint64(0))
    keep = left >= width
    keep[bounds[:-1][counts > 0]] = True
    return mixed(total[keep]), np.concatenate([[0], np.cumsum(keep)])[bounds]
