"""Candidate search shared by the two exact-repeat operators.

Every document is cut into anchor *segments*: an anchor k-gram with as much
context on both sides as a window of the wanted length that holds it can need.
Two equal windows hold the same anchor, so only segments whose anchor occurs in
another document (or earlier in the same one) can matter. A segment equal to an
earlier one is settled at once: all its windows repeat. Of the others, a window
that repeats reaches at least half of the remaining length to one side of its
anchor, so segments stay in question only if another shares that half, left or
right. What is left goes to the operator's own index.

Rows that share a segment are folded inside each map task first, so a passage
held by a third of all documents sends one row per task, not one per document.
An anchor that many documents hold in different surroundings is never gathered:
a sample names such anchors, their segments are dealt out one by one, and what
must be known of a whole anchor or half comes from partial aggregates that are
joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm import _work as W

#: Text bytes a map task folds together before it sends rows on.
FOLD_BYTES = 32 << 20
#: Anchors whose first places lie in one region of this many items of one document have one route.
REGION = 4096
#: Share of the documents that is sampled for heavy anchors, and of the sample that must hold one; documents at least.
SAMPLE, HEAVY, LEAST = 0.02, 0.005, 16

ANCHOR_SCHEMA = "g long, sh long, core long, doc_id long, at long, settled boolean"
_ARROW = pa.schema([("g", pa.int64()), ("sh", pa.int64()), ("core", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("settled", pa.bool_())])


class Shape:
    """Window length, anchor length, and how a text becomes item hashes."""

    def __init__(self, window: int, gram: int, items: Callable[[str | None], np.ndarray], again: Callable[[str | None], np.ndarray] | None = None):
        if not 1 <= gram <= window:
            raise ValueError("the anchor must fit in the window")
        self.window, self.gram, self.items, self._again = window, gram, items, again
        self.span = window - gram + 1

    def of_text(self, text: str | None):
        """``anchors`` of a text."""
        return self.anchors(self.items(text), self._again(text) if self._again else None)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors."""
        grams = H.windows(h, self.gram)
        at = H.anchors(grams, self.span)
        return at, grams[at]

    def anchors(self, h: np.ndarray, again: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions, anchor hashes, segment hashes, segment starts and ends, hashes of both halves; ``again`` is that of h, if known."""
        at, g = self.places(h)
        n = len(h)
        lo = np.maximum(at - (self.span - 1), 0)
        hi = np.minimum(at + self.window, n)
        if not len(at):
            none = np.empty(0, dtype=np.uint64)
            return at, none, none, lo, hi, none
        up, down = H._power(1, n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((H.again(h) if again is None else again) * down, out=total[1:])
        part = lambda a, b: H.mix64((total[b] - total[a]) * up[a])
        # The anchor's offset is part of it: only segments that align in full are equal.
        seg = H.mix64(part(lo, hi) ^ ((at - lo).astype(np.uint64) << np.uint64(32)) ^ (hi - lo).astype(np.uint64))
        half = self.span // 2
        left, right = at - half, at + self.gram + half
        own = seg & np.uint64(0xFFFFFFFF)
        # Where the text ends sooner no window reaches that far: such a half is like no other.
        cl = np.where(left >= 0, part(np.maximum(left, 0), at + self.gram) & np.uint64(0xFFFFFFFF), own)
        cr = np.where(right <= n, part(at, np.minimum(right, n)) & np.uint64(0xFFFFFFFF), own)
        return at, g, seg, lo, hi, (cl << np.uint64(32)) | cr


def segment_rows(docs: DataFrame, shape: Shape) -> DataFrame:
    """One row per distinct segment of each document, folded within the task.

    ``settled`` rows are known to repeat an earlier document's segment.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            g, s, c, d, p = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((d, s, g))  # stable: of one document's the first place comes first
            g, s, c, d, p = g[order], s[order], c[order], d[order], p[order]
            same = np.zeros(len(g), dtype=bool)
            same[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
            again = same.copy()
            again[1:] &= d[1:] == d[:-1]
            # A row behind the first of its segment, from a larger document, repeats it.
            settled = same & ~again
            first = np.flatnonzero(~same)
            head = d[first][np.cumsum(~same) - 1]
            settled &= d > head
            keep = ~same | settled
            return pa.RecordBatch.from_arrays([pa.array(H.signed(g[keep])), pa.array(H.signed(s[keep])), pa.array(H.signed(c[keep])), pa.array(d[keep]), pa.array(p[keep]), pa.array(settled[keep])], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if doc is None or not text:
                    continue
                at, g, s, _, _, c = shape.of_text(text)
                if len(g):
                    held.append((g, s, c, np.full(len(g), doc, dtype=np.int64), at.astype(np.int64)))
                size += len(text)
                if size >= FOLD_BYTES and held:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(fold, ANCHOR_SCHEMA)


def heavy_anchors(docs: DataFrame, shape: Shape, history: DataFrame | None = None) -> DataFrame:
    """Anchors that many documents hold, of ``docs`` or of ``history``, by samples; stored. At most 2 / ``HEAVY`` times a document's anchors.

    It only settles how rows are dealt out: an anchor is treated alike,
    whether it is listed or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if doc is not None and text:
                    g = H.signed(np.unique(shape.places(shape.items(text))[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), doc, dtype=np.int64))], names=["g", "doc_id"])

    drawn = lambda df: df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(SAMPLE * (1 << 20)))

    def heavy(rows: DataFrame) -> DataFrame:
        least = rows.agg(F.greatest(F.lit(LEAST), HEAVY * F.approx_count_distinct("doc_id")).alias("least"))
        return rows.groupBy("g").agg(F.count("*").alias("n")).join(F.broadcast(least), F.col("n") >= F.col("least")).select("g")

    found = heavy(W.store(drawn(docs.select("doc_id", "text")).mapInArrow(run, "g long, doc_id long"), "sampled"))
    if history is not None:
        found = found.unionByName(heavy(drawn(history).select("g", "doc_id"))).distinct()
    return W.store(found, "heavy")


def flag_segments(rows: DataFrame, heavy: DataFrame, hot: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, route, kind): 0 settled, 1 to compare, 2 to compare and more than ``hot`` such segments; stored.

    ``id`` is the segment's hash where settled, else the anchor's; ``route``
    leads anchors whose first places are near each other to one place.

    The segments of an anchor meet in one place, but those of a ``heavy`` one:
    they are dealt out by segment, and again by their halves.
    ``history`` holds unsettled rows of earlier batches; their documents are
    flagged where a row of ``rows`` may repeat them, and only there.
    """
    settled = rows.where("settled").select("doc_id", F.col("sh").alias("id"), F.lit(0).cast("long").alias("route"), F.lit(0).alias("kind"))
    fresh = rows.where(~F.col("settled")).drop("settled").withColumn("fresh", F.lit(1))
    if history is not None:
        keys = W.store(fresh.select("g").distinct(), "keys")
        fresh = fresh.unionByName(history.join(W.bounded(keys), "g", "left_semi").withColumn("fresh", F.lit(0)))
    marked = F.broadcast(heavy.select(F.col("g").alias("heavy")))
    dealt = fresh.join(marked, F.col("g") == F.col("heavy"), "left").withColumn("part", F.when(F.col("heavy").isNotNull(), F.col("sh")).otherwise(0))
    left, right = F.shiftright("core", 32), F.col("core").bitwiseAND(0xFFFFFFFF)
    group = lambda *more: Window.partitionBy("g", "part", *more)
    span = lambda c: F.min("sh").over(group(c)) < F.max("sh").over(group(c))
    seen = (
        dealt.withColumn("lo", F.min("sh").over(group()))
        .withColumn("hi", F.max("sh").over(group()))
        .withColumn("n", F.count("*").over(group()))
        .withColumns({"first": F.min("doc_id").over(group()), "first_at": F.min("at").over(group())})
        .withColumn("any_fresh", F.max("fresh").over(group()))
        .where("heavy is not null or any_fresh = 1 and n > 1")
        .withColumn("head", F.min("doc_id").over(group("sh")))
        .where("heavy is not null or lo < hi or head < doc_id")
        .withColumns({"left": left, "right": right})
        .withColumn("met", span("left") | span("right"))
        .where("head < doc_id or met or heavy is not null")
    )
    later = F.col("head") < F.col("doc_id")
    kind = F.when(later, 0).when(F.col("heavy").isNotNull(), 3).when(F.col("n") > F.lit(hot if hot else 1 << 62), 2).otherwise(1)
    first = W.store(
        seen.select("doc_id", "g", "sh", "at", "left", "right", "n", "any_fresh", _route("first", "first_at").alias("route"), kind.alias("kind")).withColumn("id", F.when(F.col("kind") == 0, F.col("sh")).otherwise(F.col("g"))), "first"
    )
    flags = first.where("kind < 3").select("doc_id", "id", "route", "kind")
    flags = W.store(flags.unionByName(settled).unionByName(_flag_heavy(first.where("kind = 3"), hot)), "flags")
    W.drop(first)
    return flags


def _route(doc: str, at: str) -> Column:
    return F.xxhash64(doc, F.floor(F.col(at) / REGION))


def _flag_heavy(pending: DataFrame, hot: int | None) -> DataFrame:
    """The flags of heavy anchors' segments, one row for each, by partial aggregates that are stored and joined back."""
    heads = W.store(pending.groupBy("g", "sh").agg(F.min("doc_id").alias("doc_id"), F.min_by("at", "doc_id").alias("at"), F.first("left").alias("left"), F.first("right").alias("right"), F.max("n").alias("n"), F.max("any_fresh").alias("any_fresh")), "heads")
    side = lambda i, c: F.struct(F.lit(i).alias("side"), F.col(c).alias("half"))
    halves = heads.select("*", F.explode(F.array(side(0, "left"), side(1, "right"))).alias("s")).select("g", "sh", "doc_id", "at", "n", "any_fresh", "s.*")
    meeting = W.store(halves.groupBy("g", "side", "half").agg(F.min("sh").alias("lo"), F.max("sh").alias("hi"), F.max("any_fresh").alias("fresh")).where("lo < hi and fresh = 1").select("g", "side", "half"), "meeting")
    met = halves.join(W.bounded(meeting), ["g", "side", "half"], "left_semi").dropDuplicates(["g", "sh"])
    groups = W.store(heads.groupBy("g").agg(F.sum("n").alias("in_group"), F.min("doc_id").alias("first"), F.min_by("at", "doc_id").alias("first_at")), "groups")
    kind = F.when(F.col("in_group") > F.lit(hot if hot else 1 << 62), 2).otherwise(1)
    return met.join(W.bounded(groups), "g").select("doc_id", F.col("g").alias("id"), _route("first", "first_at").alias("route"), kind.alias("kind"))


def by_document(flags: DataFrame) -> DataFrame:
    """What is flagged in each document, one array per kind; never more than the document has anchors."""
    pick = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("id")))
    return flags.groupBy(F.col("doc_id").alias("flag_doc")).agg(pick(0).alias("whole"), pick(1).alias("part"), F.collect_list(F.when(F.col("kind") == 1, F.col("route"))).alias("route"), pick(2).alias("hot"))
