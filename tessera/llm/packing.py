"""Best-fit packing with swap-based local search.

Documents are tokenised once, on the executors, into pieces of at most
``capacity`` ids; only piece lengths go on. Packing needs no more than their
histogram (at most ``capacity`` counts), so the driver packs *kinds* of bins,
each with the number of bins alike: best fit by falling length, then a local
search that exchanges one piece for one, two for one, or moves one between
underfull bins as long as the sum of squared fills grows, which drains the
emptiest bins until they vanish. Every piece then finds its bin and place from
its rank among the pieces of its length.

Defined results: a null or empty text is one piece, the closing id 0; documents
longer than ``capacity`` are cut into full pieces and a last shorter one; a
null ``doc_id`` stays null; repeated rows are packed each. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _work as W

CAPACITY, END = 2048, 0
#: Tried exchanges of the local search; it ends sooner when none helps.
STEPS = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("local", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts of plain characters only, and the pieces that the tokenizer's own pattern cuts from them once lower-cased.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+")
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Plain characters in many neighbourhoods: a tokenizer that cuts these as ``_PIECE`` does is known.
_PROBE = "It's we'll I'd they've 'm 're o't 12ab3 x--y!?(z) \t a\nb " + "".join(map(chr, [*range(33, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])) + " \u00c41\u00df2\u00e9! 'S 'T"
#: Text that is cut and looked up at a time; cached pieces.
CHUNK, CACHED = 2 << 20, 600_000


class PieceIds:
    """Ids of whole texts as little-endian bytes, from a cache of pieces.

    White space always ends a piece. Plain texts are cut into the tokenizer's
    pieces here; unseen pieces of letters are tokenised together, and the token
    that closes a piece tells them apart again. Other texts are cut at ASCII
    white space only, and each word is tokenised on its own. A tokenizer that
    cuts a probe otherwise is given whole texts instead.
    """

    def __init__(self, path: str, most: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.pieces: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.closing[i] = token.endswith("</w>")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

        self.known = self._cuts_alike()

    def _cuts_alike(self) -> bool:
        normal, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normal is None or cutter is None:
            return False
        text = normal.normalize_str(_PROBE)
        return [text[a:b] for _, (a, b) in cutter.pre_tokenize_str(text)] == _PIECE.findall(_PROBE.lower())

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, unseen: set[str]) -> None:
        letters = []
        for piece in unseen:
            if _LETTERS.fullmatch(piece):
                letters.append(piece)
            else:
                self.pieces[piece] = self.encode(piece)
        for at in range(0, len(letters), 4096):
            some = letters[at : at + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.closing[ids]) + 4).tolist()
            if len(ends) != len(some):
                raise ValueError("this tokenizer does not close pieces of letters")
            raw = ids.tobytes()
            self.pieces.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not ("<|" in text and any(s in text for s in self.special))

    def _by_word(self, text: str) -> bytes:
        out = []
        for word in text.encode("utf-8", "replace").split():
            if word not in self.words:
                self.words[word] = self.encode(word.decode("utf-8"))
            out.append(self.words[word])
        return b"".join(out)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        if not self.known:
            return [self.encode(t or "") for t in texts]
        cut = [_PIECE.findall(t.lower()) if t and self._plain(t) else None for t in texts]
        self._learn(set().union(*(c for c in cut if c)) - self.pieces.keys())
        out = [b"".join(map(self.pieces.__getitem__, c)) if c is not None else self._by_word(t or "") for c, t in zip(cut, texts)]
        # The pieces met first are the frequent ones: they stay.
        for cache in (self.pieces, self.words):
            if len(cache) > self.most:
                for key in list(cache)[self.most // 2 :]:
                    del cache[key]
        return out


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in runs of about ``CHUNK`` characters, with the first one's place."""
    first, some, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py()
        some.append(t)
        size += len(t or "")
        if size >= CHUNK:
            yield first, some
            first, some, size = i + 1, [], 0
    if some:
        yield first, some


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    ids_of = PieceIds(path)
    task = TaskContext.get().partitionId()
    ranks: dict[int, int] = defaultdict(int)
    for batch in batches:
        rows = []
        docs = batch.column("doc_id").to_pylist()
        for first, texts in _chunks(batch.column("text")):
            for doc, ids in zip(docs[first:], ids_of.texts(texts)):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, ranks[length]))
                    ranks[length] += 1
        columns = list(zip(*rows)) if rows else [[]] * len(_PIECES_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _PIECES_ARROW)], schema=_PIECES_ARROW)


Bins = dict[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Kinds of bins and how many of each: best fit by falling length, alike pieces together."""
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    open_rooms: list[int] = []
    import bisect

    def put(kind: tuple[int, ...], n: int) -> None:
        room = capacity - sum(kind)
        if not rooms[room]:
            bisect.insort(open_rooms, room)
        rooms[room][kind] = rooms[room].get(kind, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(open_rooms, length)
            if i == len(open_rooms):
                each = min(capacity // length, left)
                n = left // each
                put((length,) * each, n)
                left -= n * each
                continue
            room = open_rooms[i]
            kind, n = next(iter(rooms[room].items()))
            fit = min(room // length, left)
            use = min(n, left // fit)
            if use == n:
                del rooms[room][kind]
            else:
                rooms[room][kind] = n - use
            if not rooms[room]:
                open_rooms.pop(i)
            put((*kind, *(length,) * fit), use)
            left -= use * fit
    done: Bins = {}
    for kinds in rooms.values():
        for kind, n in kinds.items():
            if n:
                key = tuple(sorted(kind, reverse=True))
                done[key] = done.get(key, 0) + n
    return done


def _exchange(low: tuple[int, ...], high: tuple[int, ...], room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What of ``low`` goes to ``high`` and what comes back, raising ``high`` by as much as fits."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None
    mine, theirs = sorted(set(low)), sorted(set(high))
    pairs = {x + y: (x, y) for i, x in enumerate(low) for y in low[i + 1 :]}
    for give in [(x,) for x in mine] + list(pairs.values()):
        size = sum(give)
        for take in ([()] if len(give) == 1 else []) + [(y,) for y in theirs]:
            d = size - sum(take)
            if 0 < d <= room and (best is None or d > best[0]):
                best = (d, give, take)
    return best and best[1:]


def _without(kind: tuple[int, ...], parts: tuple[int, ...]) -> tuple[int, ...]:
    left = list(kind)
    for p in parts:
        left.remove(p)
    return tuple(left)


def local_search(bins: Bins, capacity: int, steps: int = STEPS) -> Bins:
    """Drain the emptiest bins into underfull ones while the sum of squared fills grows."""
    bins = dict(bins)
    least = math.ceil(sum(sum(k) * n for k, n in bins.items()) / capacity)
    under = {k for k in bins if sum(k) < capacity}
    stuck: set[tuple[int, ...]] = set()
    tried = 0

    def change(kind: tuple[int, ...], n: int) -> None:
        if not kind:
            return
        bins[kind] = bins.get(kind, 0) + n
        if not bins[kind]:
            del bins[kind]
            under.discard(kind)
        elif sum(kind) < capacity:
            under.add(kind)

    while tried < steps and sum(bins.values()) > least:
        free = [k for k in under if k not in stuck]
        if not free:
            break
        low = min(free, key=lambda k: (sum(k), k))
        fill, moved = sum(low), False
        for high in sorted(under, key=lambda k: (-sum(k), k)):
            tried += 1
            if tried >= steps:
                break
            if high == low and bins[low] < 2:
                continue
            swap = _exchange(low, high, capacity - sum(high))
            if swap is None:
                continue
            give, take = swap
            d = sum(give) - sum(take)
            if sum(high) + d <= fill:
                continue
            n = bins[low] // 2 if high == low else min(bins[low], bins[high])
            new_low = tuple(sorted((*_without(low, give), *take), reverse=True))
            new_high = tuple(sorted((*_without(high, take), *give), reverse=True))
            change(low, -n)
            change(high, -n)
            change(new_low, n)
            change(new_high, n)
            stuck.clear()
            moved = True
            break
        if not moved:
            stuck.add(low)
    return bins


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Bins:
    return local_search(best_fit(counts, capacity), capacity, steps)


class Places:
    """Bin and offset of the n-th piece of each length."""

    def __init__(self, bins: Bins):
        slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        base = 0
        for kind in sorted(bins, reverse=True):
            at = 0
            for length in kind:
                slots[length].append((bins[kind], base, at))
                at += length
            base += bins[kind]
        self.by_length = {k: (np.cumsum([s[0] for s in v]), np.array([s[0] for s in v]), np.array([s[1] for s in v]), np.array([s[2] for s in v])) for k, v in slots.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            ends, n, base, offset = self.by_length[length]
            i = np.searchsorted(ends, ranks[at], side="right")
            bins[at] = base[i] + ranks[at] - (ends[i] - n[i])
            offsets[at] = offset[i]
        return bins, offsets


def pieces_of(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their length, checksum, and rank among the task's pieces of that length."""
    path = tokenizer or default_tokenizer()
    return documents.select("doc_id", "text").mapInArrow(lambda it: _cut(it, path, capacity), _PIECES)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PACKED_ARROW = pa.schema([*list(_PIECES_ARROW)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """Each piece of each document with its sequence and its place there."""
    pieces = W.store(pieces_of(documents, tokenizer, capacity), "pieces")
    by_task = pieces.groupBy("task", "length").count()
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    places = Places(pack_counts(counts, capacity, steps))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("local")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, offsets = places.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins), pa.array(offsets)], schema=_PACKED_ARROW)

    return ranked.mapInArrow(place, _PACKED)
