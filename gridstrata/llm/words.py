"""Words of whole texts as numpy arrays: positions, 64-bit hashes and hashes of runs of words.

A word is a run of bytes other than ASCII blanks (0x20, 0x09 to 0x0D) of the UTF-8 text. Texts of any length are worked
through in slices, so that no array is many times larger than the text itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(step: np.uint64, n: int) -> np.ndarray:
    """1, step, step², … modulo 2^64."""
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 places at which texts begin and end."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    places = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def spans(data: np.ndarray, places: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each text; ``blank`` marks the bytes between words."""
    full = ~blank[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    edges = places[:-1][places[:-1] < len(data)]
    first[edges] = full[edges]
    last = full.copy()
    last[:-1] &= ~full[1:]
    edges = edges[edges > 0] - 1
    last[edges] = full[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, places))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    table = powers(_STEP, int(lengths.max()) if len(lengths) else 1)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + _SLICE, "right")) - 1)
        own = total[at:to] - total[at]
        n = int(total[to] - total[at])
        inside = np.arange(n) - np.repeat(own, lengths[at:to])
        bytes_ = data[inside + np.repeat(starts[at:to], lengths[at:to])]
        out[at:to] = np.add.reduceat(_BYTE[bytes_] * table[inside], own)
        at = to
    return mix(out + lengths.astype(np.uint64))


def runs(h: np.ndarray, counts: np.ndarray, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words inside one text, and the index of the first word of each."""
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = np.uint64((0xD6E8FEB86659FD93 + 2 * salt) % 2**64)
    back = np.uint64(pow(int(step), -1, 2**64))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((mix(h + np.uint64(salt)) if salt else h) * powers(step, len(h)), out=total[1:])
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
    at = np.flatnonzero(left >= size)
    return mix((total[at + size] - total[at]) * powers(back, len(h))[at]), at
