"""Vectorised window hashing and anchor selection over words or bytes.

A *window hash* of k consecutive items is the polynomial sum of their 64-bit
hashes modulo 2**64, taken from one prefix sum, then finalised. Two independent
lanes give 128 bits; windows are called equal when both lanes agree.

An *anchor* is a position whose k-gram hash is the least in some run of
``span`` consecutive k-grams (every tie is kept). Each run holds an anchor, and
equal runs hold the same anchors, so any two equal stretches of ``span + k - 1``
items share one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

_U = np.uint64
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _power(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        base = _LANES[lane]
        size = max(n, 1 << 15)
        up = np.full(size, base, dtype=_U)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=_U)
        up[0] = down[0] = 1
        have = _powers[lane] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def windows(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of k items; empty when there are fewer."""
    n = len(h)
    if n < k or k < 1:
        return np.empty(0, dtype=_U)
    up, down = _power(lane, n)
    total = np.empty(n + 1, dtype=_U)
    total[0] = 0
    items = h if lane == 0 else mix64(h ^ _U(0xA5A5A5A55A5A5A5A))
    np.cumsum(items * down, out=total[1:])
    return mix64((total[k:] - total[:-k]) * up[: n - k + 1])


def spans(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the items in each [lo, hi)."""
    up, down = _power(lane, max(len(h), 1))
    total = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum((h if lane == 0 else mix64(h ^ _U(0xA5A5A5A55A5A5A5A))) * down[: len(h)], out=total[1:])
    return mix64((total[hi] - total[lo]) * up[np.minimum(lo, max(len(h) - 1, 0))] ^ (hi - lo).astype(_U))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null and blank texts have none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes], key: str = "0123456789123456") -> np.ndarray:
    """64-bit hashes; another key of 16 characters gives others that are independent."""
    if not words:
        return np.empty(0, dtype=_U)
    return pd.util.hash_array(np.array(words, dtype=object), hash_key=key, categorize=False)


_bytes_table = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


_bytes_again = mix64(_bytes_table ^ _U(0x1234567))


def byte_hashes(raw: bytes) -> np.ndarray:
    return _bytes_table[np.frombuffer(raw, dtype=np.uint8)]


def byte_hashes_again(raw: bytes) -> np.ndarray:
    """``again`` of a text's byte hashes, from a table."""
    return _bytes_again[np.frombuffer(raw, dtype=np.uint8)]


def again(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same items."""
    return mix64(h ^ _U(0x1234567))


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over each w consecutive values, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the least hash of some ``span`` consecutive k-grams."""
    n = len(grams)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n < span:
        return np.empty(0, dtype=np.int64)
    least = _slide(grams, span, np.minimum)
    padded = np.zeros(n + span - 1, dtype=_U)
    padded[span - 1 : span - 1 + len(least)] = least
    return np.flatnonzero(grams == _slide(padded, span, np.maximum))


def spans_of(mask: np.ndarray) -> np.ndarray:
    """(start, end) of each run of True."""
    if not mask.any():
        return np.empty((0, 2), dtype=np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def cover(n: int, starts: np.ndarray, width) -> np.ndarray:
    """Which of n items lie in [s, s + width) for some s."""
    if not len(starts):
        return np.zeros(n, dtype=bool)
    marks = np.zeros(n + 1, dtype=np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + width, n), -1)
    return np.cumsum(marks[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit integers, as Spark's long holds them."""
    return x.view(np.int64)
