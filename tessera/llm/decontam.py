"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. One pass over the corpus
counts the items' words; from the counts an n-gram's expected number of chance
occurrences follows, and an item's seeds are its n-grams that chance alone would
hardly bring about. A second pass lists where documents may hold a seed, and
these places are joined with the seeds of all items. For each document and item
that meet, the item is aligned with the words around the seeds, and the best
local alignment is scored as a share of a perfect copy.

Both passes are narrowed in the map task by a Bloom filter of the wanted hashes,
at most ``SLOTS`` words of 64 bits whatever the benchmark's size: what passes it
wrongly is lost in the join. A passage that a third of all documents hold is
many rows on one side of that join and one seed on the other, so a skewed
partition can be split. Alignment keeps one row of the table at a time.

Defined results: null and wordless texts or items match nothing; items with the
same text match alike; items shorter than a seed are one seed; a null
``doc_id`` or ``item_id`` is reported as null. Repeated rows are reported each.
Empty tables give an empty result; other columns are ignored, and pass through
``decontaminate``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm import _work as W

#: 64-bit words of a filter at most: 16 MB.
SLOTS = 1 << 21
#: Share of a perfect copy's score from which a passage counts as leaked, and words that must agree (or all of a shorter item).
THRESHOLD, LEAST_WORDS = 0.5, 6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seed lengths, tried in order, and the chance occurrences in the whole corpus that a seed may have.
LENGTHS, CHANCE = (3, 4, 5, 6, 8), 0.5
#: Word hashes a counting task holds before it folds them.
HELD = 1 << 22

_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def _hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.empty(0, dtype=np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: score, agreeing words, and where in the passage it starts and ends.

    Each cell carries where its alignment starts and how many words agree in
    it, so only the row before is needed.
    """
    m = len(passage)
    place = np.arange(m + 1, dtype=np.int64)
    score = np.zeros(m + 1, dtype=np.int64)
    start, same = place.copy(), np.zeros(m + 1, dtype=np.int64)
    base, from_, agree = np.zeros(m + 1, dtype=np.int64), place.copy(), np.zeros(m + 1, dtype=np.int64)
    best = (0, 0, 0, 0)
    for word in item:
        hit = passage == word
        ahead, down = score[:-1] + np.where(hit, MATCH, MISMATCH), score[1:] + GAP
        straight = ahead >= down
        top = np.maximum(ahead, down)
        live = top > 0
        base[1:] = np.where(live, top, 0)
        from_[1:] = np.where(live, np.where(straight, start[:-1], start[1:]), place[1:])
        agree[1:] = np.where(live, np.where(straight, same[:-1] + hit, same[1:]), 0)
        # Gaps along the passage: a running maximum after levelling their cost, which remembers where it comes from.
        run = np.maximum.accumulate((base - GAP * place) * (m + 1) + place)
        source = run % (m + 1)
        score, start, same = run // (m + 1) + GAP * place, from_[source], agree[source]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(same[j]), int(start[j]), j)
    return best


class Filter:
    """A blocked Bloom filter of 64-bit hashes: three bits in one word of 64."""

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        self.power = max(10, min(SLOTS.bit_length() - 1, math.ceil(math.log2(n + 1))))
        bit = lambda at: f"shiftleft(1L, cast(shiftrightunsigned({column}, {at}) & 63 AS INT))"
        rows = keys.select(F.shiftrightunsigned(column, 64 - self.power).alias("slot"), F.expr(" | ".join(map(bit, (0, 6, 12)))).alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(1 << self.power, dtype=np.uint64)
        self.words[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)  # at most SLOTS rows

    def passes(self, keys: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        bits = (one << (keys & low)) | (one << ((keys >> np.uint64(6)) & low)) | (one << ((keys >> np.uint64(12)) & low))
        return self.words[(keys >> np.uint64(64 - self.power)).astype(np.int64)] & bits == bits


def _items(benchmark: DataFrame) -> DataFrame:
    """ikey, item_id and word hashes of every item with words; rows with equal ikey are equal."""
    schema = pa.schema([("ikey", pa.int64()), ("item_id", pa.int64()), ("words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                h = _hashes(words_of(text))
                if len(h):
                    raw = f"{item}\n{text}".encode("utf-8", "surrogatepass")
                    rows.append((int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True), item, H.signed(h)))
            yield _batch(rows, schema)

    return benchmark.select("item_id", "text").mapInArrow(run, "ikey long, item_id long, words array<long>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def word_counts(documents: DataFrame, words: DataFrame) -> tuple[DataFrame, int]:
    """(w, n) for the wanted hashes that the corpus holds, maybe some others too; and the corpus' words."""
    wanted = documents.sparkSession.sparkContext.broadcast(Filter(words, "w"))
    schema = pa.schema([("w", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = 0, [], 0

        def fold() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(H.signed(w)), pa.array(n.astype(np.int64))], schema=schema)

        for b in batches:
            for t in b.column("text"):
                h = _hashes(words_of(t.as_py()))
                total += len(h)
                held.append(h[wanted.value.passes(h)])
                size += len(held[-1])
                if size >= HELD:
                    yield fold()
                    held, size = [], 0
        if held:
            yield fold()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], schema=schema)

    counts = W.store(documents.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("w is null").first()
    return counts.where("w is not null"), total["n"] if total else 0


def _key(grams: np.ndarray, size: int) -> np.ndarray:
    return H.mix64(grams ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def seeds_of(h: np.ndarray, counts: np.ndarray, total: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Length, offsets and hashes of an item's seeds, from its words' corpus counts."""
    rare = np.where(counts > 0, np.log(np.maximum(counts, 1) / max(total, 1)), -math.log(total + 1))
    for size in LENGTHS:
        size = min(size, len(h))
        expected = math.log(total + 1) + np.convolve(rare, np.ones(size), "valid")
        good = expected <= math.log(CHANCE)
        if 2 * good.sum() >= len(good) or size == min(LENGTHS[-1], len(h)):
            good |= expected <= expected.min() + math.log(2)
            at = np.flatnonzero(good)
            return size, at, _key(H.windows(h, size)[at], size)
    raise AssertionError("the last length is always taken")


def seeds(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(key, size, ikey, at): where each item has its seeds."""
    words = W.store(items.dropDuplicates(["ikey"]).select("ikey", F.posexplode("words").alias("at", "w")), "words")
    counts, total = word_counts(documents, words.select("w").distinct())
    known = words.join(W.bounded(counts), "w", "left").groupBy("ikey").agg(F.sort_array(F.collect_list(F.struct("at", "w", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("words"))
    schema = pa.schema([("key", pa.int64()), ("size", pa.int32()), ("ikey", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ikey, w in zip(b.column("ikey").to_pylist(), b.column("words")):
                _, words, n = w.values.flatten()
                h, n = words.to_numpy().view(np.uint64), n.to_numpy()
                size, at, keys = seeds_of(h, n, total)
                yield pa.RecordBatch.from_arrays([pa.array(H.signed(keys)), pa.array(np.full(len(at), size, dtype=np.int32)), pa.array(np.full(len(at), ikey, dtype=np.int64)), pa.array(at.astype(np.int32))], schema=schema)

    return known.mapInArrow(run, "key long, size int, ikey long, at int")


def _joined(diagonals: list[int], n: int, slack: int, size: int) -> Iterator[tuple[int, int]]:
    lo = hi = None
    for d in diagonals:
        a, b = max(0, d - slack), min(size, d + n + slack)
        if lo is not None and a <= hi:
            hi = max(hi, b)
            # A long run of seeds is aligned piece by piece, each with room to both sides.
            while hi - lo > 8 * (n + 2 * slack):
                yield lo, lo + 4 * (n + 2 * slack)
                lo += 4 * (n + 2 * slack) - (n + 2 * slack)
        else:
            if lo is not None:
                yield lo, hi
            lo, hi = a, b
    if lo is not None:
        yield lo, hi


def best_match(item: np.ndarray, words: np.ndarray, diagonals: list[int]) -> tuple[float, int, int, int] | None:
    """Share, agreeing words, start and end of the best alignment near the diagonals, if it counts as a leak."""
    n, best = len(item), (0, 0, 0, 0)
    for lo, hi in _joined(sorted(diagonals), n, max(8, n // 2), len(words)):
        score, same, a, b = align(item, words[lo:hi])
        if score > best[0]:
            best = (score, same, lo + a, lo + b)
    if best[0] >= THRESHOLD * MATCH * n and best[1] >= min(LEAST_WORDS, n):
        return best[0] / (MATCH * n), best[1], best[2], best[3]
    return None


_SCHEMA = "dkey long, doc_id long, item_id long, score double, n_same int, start int, end int"
_ARROW = pa.schema([("dkey", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_same", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks, with the key of the document's row."""
    items = W.store(_items(benchmark), "items")
    docs = documents.select(F.xxhash64("doc_id", "text").alias("dkey"), "doc_id", "text").where("text is not null")
    found = W.store(seeds(docs, items), "seeds")
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())  # at most the largest length
    wanted = documents.sparkSession.sparkContext.broadcast(Filter(found.select("key").distinct(), "key"))
    schema = pa.schema([("dkey", pa.int64()), ("p", pa.int32()), ("key", pa.int64())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dkey, t in zip(b.column("dkey").to_pylist(), b.column("text")):
                h = _hashes(words_of(t.as_py()))
                for size in sizes:
                    keys = _key(H.windows(h, size), size)
                    p = np.flatnonzero(wanted.value.passes(keys))
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), dkey, dtype=np.int64)), pa.array(p.astype(np.int32)), pa.array(H.signed(keys[p]))], schema=schema)

    held = docs.select("dkey", "text").mapInArrow(places, "dkey long, p int, key long")
    met = held.join(W.bounded(found.select("key", "ikey", "at")), "key").groupBy("dkey", "ikey").agg(F.collect_set(F.col("p") - F.col("at")).alias("diagonals"))
    met = W.store(met, "met")
    near = met.join(items, "ikey").groupBy("dkey").agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("items"))
    ids = W.store(met.select("dkey").distinct(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dkey, doc, text, pairs in zip(b.column("dkey").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), b.column("items")):
                h = _hashes(words_of(text.as_py()))
                rows = []
                for x in pairs:
                    item = x["words"].values.to_numpy().view(np.uint64)
                    hit = best_match(item, h, x["diagonals"].as_py())
                    if hit:
                        rows.append((dkey, doc, x["item_id"].as_py(), *hit))
                yield _batch(rows, _ARROW)

    return W.with_ids(docs, ids, "left_semi", on="dkey").join(near, "dkey").select("dkey", "doc_id", "text", "items").mapInArrow(run, _SCHEMA)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that leaks into it: score, agreeing words, first and past-last word."""
    return _matches(documents, benchmark).drop("dkey")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item leaks into, with all their columns."""
    key = W.free_name(documents, "dkey")
    gone = W.store(_matches(documents, benchmark).select("dkey").distinct(), "leaking")
    return W.with_ids(documents.withColumn(key, F.xxhash64("doc_id", "text")), gone, "left_anti", on=key).drop(key)
