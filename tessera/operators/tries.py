"""Tries of candidate boxes as vectors: the draws and boxes of ``generate`` for many rows and attempts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Tries that are worked out at once: their arrays stay in the processor's cache.
AT_ONCE = 8192
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(np.sin(i + 1.0)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_U = np.uint32


def md5_heads(texts: np.ndarray) -> np.ndarray:
    """The first 13 hexadecimal digits of each row's md5; rows of bytes of one length, at most 55."""
    n, size = texts.shape
    block = np.zeros((n, 64), dtype=np.uint8)
    block[:, :size] = texts
    block[:, size] = 0x80
    block[:, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), dtype=np.uint8)
    words = np.ascontiguousarray(block.view("<u4").T)
    start = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
    a, b, c, d = (np.full(n, v, dtype=_U) for v in start)
    f, t = np.empty(n, dtype=_U), np.empty(n, dtype=_U)
    for i in range(64):
        turn, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, _SINES[i], out=f), np.add(f, words[at], out=f)
        left = _SHIFTS[turn][i % 4]
        np.right_shift(f, _U(32 - left), out=t), np.left_shift(f, _U(left), out=f), np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    high, low = ((v + _U(s)).byteswap().astype(np.uint64) for v, s in zip((a, b), start))
    return (high << np.uint64(20)) | (low >> np.uint64(12))


def draws(name: str, keys: np.ndarray, attempts: np.ndarray) -> np.ndarray:
    """``policy.draw`` of the name, and of keys and attempts given as rows of bytes with their colons."""
    head = np.broadcast_to(np.frombuffer(name.encode(), dtype=np.uint8), (len(keys), len(name.encode())))
    texts = np.concatenate((head, keys, attempts), axis=1)
    if texts.shape[1] <= 55:
        return md5_heads(texts).astype(np.float64) / 16.0**13
    return np.array([int(hashlib.md5(t.tobytes()).hexdigest()[:13], 16) for t in texts], dtype=np.float64) / 16.0**13


def propose(u, r: np.ndarray, w: np.ndarray, h: np.ndarray, target: float, min_side: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a candidate, these candidates) as ``generate._proposed`` makes them; ``u(name, rows)`` draws."""
    every = np.arange(len(r))
    if target == 0:
        def side(size: np.ndarray, d: np.ndarray) -> np.ndarray:
            least = np.maximum(2, np.minimum(min_side, size))
            return (least + np.floor(d * (np.maximum(least, (size * 0.6).astype(np.int64)) - least + 1))).astype(np.int64)

        w2, h2 = side(w, u("w", every)), side(h, u("h", every))
        x, y = np.floor(u("x", every) * (w - w2 + 1)).astype(np.int64), np.floor(u("y", every) * (h - h2 + 1)).astype(np.int64)
        return every, np.stack((x, y, x + w2, y + h2), axis=1)
    normal = lambda a, b: np.sqrt(-2 * np.log(np.maximum(u(a, every), 1e-12))) * np.cos(2 * np.pi * u(b, every))
    w1, h1 = r[:, 2] - r[:, 0], r[:, 3] - r[:, 1]
    a1 = (w1 * h1).astype(np.float64)
    area = np.minimum(np.maximum(1.0, np.rint(a1 * np.exp(normal("a", "b") * (0.9 * (1 - target) + 0.08)))), w * h.astype(np.float64))
    aspect = np.exp(normal("c", "d") * 0.55)
    side = lambda v, size: np.maximum(2, np.minimum(size, np.rint(np.sqrt(v)).astype(np.int64)))
    w2, h2 = side(area * aspect, w), side(area / aspect, h)
    both = np.minimum(a1, (w2 * h2).astype(np.float64))
    need = np.maximum(0.0, np.minimum(both, target * (a1 + w2 * h2) / (1 + target)))
    ow = np.maximum(1, np.rint((0.15 + 0.85 * u("o", every)) * np.minimum(w1, w2)).astype(np.int64))
    oh = np.rint(need / ow).astype(np.int64)
    rows = np.flatnonzero((oh >= 1) & (oh <= np.minimum(h1, h2)))
    r, w, h, w1, h1, w2, h2, ow, oh = (v[rows] for v in (r, w, h, w1, h1, w2, h2, ow, oh))
    apart = lambda a, b, o, d: np.maximum(0, np.rint((a + b) / 2 - o).astype(np.int64)) * np.where(u(d, rows) < 0.5, -1, 1)
    x = np.rint((r[:, 0] + r[:, 2]) / 2 + apart(w1, w2, ow, "e") - w2 / 2).astype(np.int64)
    y = np.rint((r[:, 1] + r[:, 3]) / 2 + apart(h1, h2, oh, "f") - h2 / 2).astype(np.int64)
    inside = (x >= 0) & (y >= 0) & (x + w2 <= w) & (y + h2 <= h)
    return rows[inside], np.stack((x, y, x + w2, y + h2), axis=1)[inside]


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of integer boxes as ``geometry.overlap_int``."""
    side = lambda lo, hi: np.maximum(0, hi - lo)
    inter = side(np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 2], b[:, 2])) * side(np.maximum(a[:, 1], b[:, 1]), np.minimum(a[:, 3], b[:, 3]))
    area = lambda v: side(v[:, 0], v[:, 2]) * side(v[:, 1], v[:, 3])
    union = area(a) + area(b) - inter
    return np.where(union > 0, inter / np.maximum(union, 1), 0.0)


def digits(v: np.ndarray) -> np.ndarray:
    """Characters of each integer."""
    n = np.ones(v.shape, dtype=np.int64) + (v < 0)
    rest = np.abs(v) // 10
    while rest.any():
        n += rest > 0
        rest //= 10
    return n


def best(keys: np.ndarray, r: np.ndarray, w: np.ndarray, h: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], target: float, tolerance: float, threshold: float, seed: int, min_side: int, max_tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, box, error) of each row's best try; infinite scores have none. ``keys`` are bytes of one length; ``others`` (rows that have a box, boxes)."""
    n = len(r)
    score, box, error = np.full(n, np.inf), np.zeros((n, 4), dtype=np.int64), np.zeros(n)
    left, first, long_ref = np.arange(n), 0, digits(r)
    while first < max_tries and len(left):
        # Attempts of one length, so that all texts have one.
        last = min(first + max(1, AT_ONCE // len(left)), 10 ** len(str(first)), max_tries)
        tries = last - first
        numbers = np.frombuffer("".join(f":{t}" for t in range(first, last)).encode(), dtype=np.uint8).reshape(tries, -1)
        of = np.repeat(left, tries)
        u = lambda name, rows: draws(f"{seed}{name}", keys[of[rows]], numbers[rows % tries])  # noqa: B023,E731
        rows, cand = propose(u, r[of], w[of], h[of], target, min_side)
        at = of[rows]
        far = np.abs(overlap(r[at], cand) - target)
        ok = far <= tolerance
        for has, boxes in others:
            ok &= ~(has[at] & (overlap(boxes[at], cand) > threshold))
        good = np.full(len(of), np.inf)
        good[rows] = np.where(ok, np.where((digits(cand) == long_ref[at]).all(axis=1), -2.0, -1.0), far)
        place = np.full(len(of), -1)
        place[rows] = np.arange(len(rows))
        pick = np.arange(len(left)) * tries + good.reshape(-1, tries).argmin(axis=1)
        better = good[pick] < score[left]
        to, p = left[better], place[pick[better]]
        score[to], box[to], error[to] = good[pick[better]], cand[p], far[p]
        left, first = left[score[left] > -2], last
    return score, box, error


def runner(target: float, tolerance: float, threshold: float, seed: int, min_side: int, max_tries: int):
    """Batches (key, text, x1, y1, x2, y2, w, h, others) to (key, x1, y1, x2, y2, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            known = np.ones(n, dtype=bool)
            for c in ("x1", "y1", "x2", "y2", "w", "h"):
                known &= b.column(c).is_valid().to_numpy(zero_copy_only=False)
            number = lambda c: b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023,E731
            r, w, h = np.stack([number(c) for c in ("x1", "y1", "x2", "y2")], axis=1), number("w"), number("h")
            lists = b.column("others")
            ends = lists.offsets.to_numpy()
            flat, counts = lists.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4), np.diff(ends) // 4
            others = []
            for j in range(int(counts.max(initial=0))):
                has, boxes = counts > j, np.zeros((n, 4), dtype=np.int64)
                boxes[has] = flat[ends[:-1][has] // 4 + j]
                others.append((has, boxes))
            texts = [b"" if t is None else b":" + t.encode() for t in b.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts])
            score, box, error = np.full(n, np.inf), np.zeros((n, 4), dtype=np.int64), np.zeros(n)
            for size in np.unique(sizes[known]):
                at = np.flatnonzero(known & (sizes == size))
                keys = np.frombuffer(b"".join(texts[i] for i in at), dtype=np.uint8).reshape(len(at), size)
                score[at], box[at], error[at] = best(keys, r[at], w[at], h[at], [(has[at], boxes[at]) for has, boxes in others], target, tolerance, threshold, seed, min_side, max_tries)
            none = np.isinf(score)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(box[:, i], mask=none) for i in range(4)), pa.array(error, mask=none)], names=["key", "x1", "y1", "x2", "y2", "error"])

    return run
