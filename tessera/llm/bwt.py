"""Burrows-Wheeler transforms of shards and their merge by interleave refinement.

A shard is a run of whole byte segments, each closed by a byte that no UTF-8 text
holds. Its transform lists, for the sorted rotations, the ``stride`` bytes
before each. Shards are merged without sorting their suffixes again: the
interleave starts with the shards one behind another, and each pass deals the
rows out, stably, by the symbols before them, which orders them by ``stride``
more bytes. Rows that a pass separates get their common prefix length; after
enough passes the rows that are still together form the repeated intervals.
"""

from __future__ import annotations

import numpy as np

END = 0xFF
#: Bytes of a shard.
SHARD = 1 << 15


class Alphabet:
    """Ranks of the ``stride``-byte strings that occur, so that each is one 16-bit symbol.

    The stride is the largest of ``tried`` whose strings have at most 65,536 kinds.
    """

    def __init__(self, code: np.ndarray, depth: int, tried: tuple[int, ...] = (5, 4, 2, 1)):
        for self.stride in tried:
            if depth % self.stride:
                continue
            kinds = np.unique(packed(code, self.stride))
            if len(kinds) <= 1 << 16:
                self.kinds = kinds
                return
        raise ValueError(f"no stride of {tried} fits")

    def ranks(self, code: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.kinds, packed(code, self.stride)).astype(np.uint16)


def packed(code: np.ndarray, stride: int) -> np.ndarray:
    """The ``stride`` bytes from each position, as one number; the end wraps around."""
    key = code.astype(np.uint64)
    for i in range(1, stride):
        key = (key << np.uint64(8)) | np.roll(code, -i)
    return key


class Shard:
    """Sorted rotations of some segments, and the symbols before them."""

    def __init__(self, code: np.ndarray, alphabet: Alphabet | None, depth: int):
        self.code = code
        self.order = sort_rotations(code, depth)
        self.bwt = None
        if alphabet is not None:
            self.transform(alphabet)

    def transform(self, alphabet: Alphabet) -> None:
        self.bwt = alphabet.ranks(self.code)[self.order - alphabet.stride]


def sort_rotations(code: np.ndarray, depth: int) -> np.ndarray:
    """Rotations in order of at least their first ``depth`` bytes, by prefix doubling from 8 bytes."""
    n = len(code)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    key, done = packed(code, 8), 8
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate(([False], ranked[1:] != ranked[:-1]))).astype(np.uint64)
        if done >= depth or int(rank[order[-1]]) == n - 1:
            return order
        key = rank * np.uint64(n) + np.roll(rank, -done)
        done *= 2


def merge(shards: list[Shard], depth: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all rotations (positions in the shards laid end to end) and common prefix lengths.

    ``lcp[i]`` is the length shared by rows i-1 and i, down to a multiple of
    ``stride`` and at most ``depth``.
    """
    sizes = [len(s.code) for s in shards]
    n = sum(sizes)
    symbols = np.concatenate([s.bwt for s in shards])
    starts = np.cumsum([0, *sizes[:-1]])
    suffixes = np.concatenate([s.order + at for s, at in zip(shards, starts)])
    # The fewer bytes a shard's number has, the fewer passes its stable sort takes.
    z = np.repeat(np.arange(len(shards), dtype=np.min_scalar_type(len(shards))), sizes)
    lcp = np.full(n, -1, dtype=np.int32)
    block = np.zeros(n, dtype=np.int32)
    before = np.empty(n, dtype=symbols.dtype)
    for step in range(0, depth, stride):
        before[np.argsort(z, kind="stable")] = symbols
        to = np.argsort(before, kind="stable")
        z = z[to]
        block, head = block[to], before[to]
        cut = np.ones(n, dtype=bool)
        cut[1:] = (head[1:] != head[:-1]) | (block[1:] != block[:-1])
        lcp[cut & (lcp < 0)] = step
        block = np.cumsum(cut, dtype=np.int32)
        if block[-1] == n:
            break
    lcp[lcp < 0] = depth
    merged = np.empty(n, dtype=np.int64)
    merged[np.argsort(z, kind="stable")] = suffixes
    return merged, lcp


def repeats(segments: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int, who: np.ndarray | None = None, shard: int = SHARD, tried: tuple[int, ...] = (5, 4, 2, 1)) -> np.ndarray:
    """Segment and offset (two columns) of each ``length``-byte string that also starts earlier.

    Earlier is in a smaller doc, or at a smaller start of the same one; ``who``
    tells documents of equal doc apart, which are not earlier than each other.
    The segments are cut into shards of about ``shard`` bytes.
    """
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    total = int(sizes.sum()) + len(segments)
    code = np.frombuffer(b"".join(s + bytes([END]) for s in segments), dtype=np.uint8)
    ends = np.cumsum(sizes + 1)
    near = ends[np.searchsorted(ends, np.linspace(0, total, max(2, -(-total // shard)) + 1)[1:-1])]
    cuts = sorted({0, *near.tolist(), total})
    parts = [code[a:b] for a, b in zip(cuts, cuts[1:])]
    # A string that wraps around a shard's end holds its closing byte; so does one across segments.
    alphabet = Alphabet(np.concatenate([np.concatenate((p, p[:8])) for p in parts]), length, tried)
    order, lcp = merge([Shard(p, alphabet, length) for p in parts], length, alphabet.stride)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    at = np.arange(total) - np.repeat(ends - sizes - 1, sizes + 1)
    # Rows of intervals, without those that are too short or alone.
    interval = np.cumsum(lcp < length)
    row = np.flatnonzero((sizes[owner] - at >= length)[order])
    row = row[np.bincount(interval[row], minlength=interval[-1] + 1)[interval[row]] > 1]
    if not len(row):
        return np.empty((0, 2), dtype=np.int64)
    interval, place = interval[row], order[row]
    doc, start = docs[owner[place]], starts[owner[place]] + at[place]
    heads = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    late = doc > np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(row))))
    # What is left is of each interval's least doc; only where that holds several rows do their starts matter.
    inner = np.flatnonzero(~late)
    inner = inner[np.bincount(interval[inner])[interval[inner]] > 1]
    if len(inner):
        own = np.unique(docs if who is None else who, return_inverse=True)[1][owner[place[inner]]]
        inner = inner[order := np.lexsort((start[inner], own, interval[inner]))]
        own = own[order]
        first = np.ones(len(inner), dtype=bool)
        first[1:] = (interval[inner[1:]] != interval[inner[:-1]]) | (own[1:] != own[:-1])
        least = start[inner][np.maximum.accumulate(np.where(first, np.arange(len(inner)), 0))]
        late[inner] = start[inner] > least
    return np.stack((owner[place[late]], at[place[late]]), axis=1)
