"""Exact byte-level dedup: repeated intervals of merged shard Burrows-Wheeler transforms.

Candidate search (``_segments``) leaves the stretches of text around anchors
that occur with different surroundings; each bucket of them is cut into shards,
transformed, and merged by interleave refinement (``bwt``). The intervals of
rows with a common prefix of ``length`` bytes are the repeated strings. As in
prefix-free parsing, stretches that are equal as a whole are one dictionary
entry: only its first place enters a transform, and the others repeat it.

Stretches meet by the region of the smallest document in which their anchor
comes first, so that neighbouring anchors of one copy travel as one stretch and
a bucket is bounded: a region has at most ``_segments.REGION`` anchors, each
with at most ``HOT`` segments. An anchor with more of them (a short line that a
third of all documents hold) has no region: its strings are dealt out by all
their bytes at once, the interleave's last refinement, first in blocks of
neighbours and then, where a block is new, one by one; the earliest of each is a
distributed minimum.

Defined results: a null or empty text has no bytes and loses none; matches
never cross documents; of equal strings the first (smallest ``doc_id``, then
smallest start) stays; rows with a null ``doc_id`` are only searched within
themselves; rows that share a ``doc_id`` are documents of their own, told apart
by their text: none is earlier than the other, so both may lose what a smaller
``doc_id`` or they themselves hold, never what the other holds. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm import _segments as S
from tessera.llm import _work as W
from tessera.llm import bwt
from tessera.llm.substring import _batch, _flagged

LENGTH, GRAM = 100, 28
#: Segments of one anchor that one region takes; bytes from which a bucket of whole regions is closed.
HOT, BUCKET = 256, 1 << 18
#: Neighbouring windows of an anchor with more, that are compared together before they are one by one.
BLOCK = 8


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _items(text: str | None) -> np.ndarray:
    return H.byte_hashes(_raw(text))


def _again(text: str | None) -> np.ndarray:
    return H.byte_hashes_again(_raw(text))


_STAGE_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string, who long, covered array<long>, segs array<struct<g:long,lo:long,raw:binary>>, blocks array<struct<a:long,b:long,lo:long,hi:long,ask:boolean,wa:array<long>,wb:array<long>>>"
_BLOCK_ARROW = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("ask", pa.bool_()), ("wa", pa.list_(pa.int64())), ("wb", pa.list_(pa.int64()))])
_STAGE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("text", pa.string()), ("who", pa.int64()), ("covered", pa.list_(pa.int64())), ("segs", pa.list_(pa.struct([("g", pa.int64()), ("lo", pa.int64()), ("raw", pa.binary())]))), ("blocks", pa.list_(_BLOCK_ARROW))])
_DONE_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_DONE_ARROW = pa.schema(list(_STAGE_ARROW)[:6])
_SPAN_SCHEMA = "hit_doc long, hit_who long, lo long, hi long"
_SPAN_ARROW = pa.schema([("hit_doc", pa.int64()), ("hit_who", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _result(doc, raw: bytes, spans: np.ndarray, keep: bool) -> tuple:
    kept, last = [], 0
    for lo, hi in spans.tolist():
        kept.append(raw[last:lo])
        last = hi
    kept.append(raw[last:])
    left = b"".join(kept)
    return doc, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if keep else None


def _late_twins(seg: np.ndarray) -> np.ndarray:
    """Segments equal to one further left in the same document."""
    if len(set(seg.tolist())) == len(seg):
        return np.zeros(len(seg), dtype=bool)
    late = np.ones(len(seg), dtype=bool)
    late[np.unique(seg, return_index=True)[1]] = False
    return late


def _own_repeats(raw: bytes, shape: S.Shape) -> np.ndarray:
    """Spans of what starts earlier in the same text, for rows that nothing else is compared with."""
    _, g, seg, lo, hi, _ = shape.anchors(H.byte_hashes(raw))
    kinds, of, n = np.unique(g, return_inverse=True, return_counts=True)
    late = _late_twins(seg)
    open_ = ~late & (n[of] > 1)
    spans = np.stack((lo[late], hi[late]), axis=1)
    if not open_.any():
        return spans
    pieces = _stretches(raw, g[open_], lo[open_], hi[open_], H.signed(kinds).tolist(), [0] * len(kinds))
    starts = np.array([p["lo"] for p in pieces], dtype=np.int64)
    found = bwt.repeats([p["raw"] for p in pieces], np.zeros(len(pieces), dtype=np.int64), starts, shape.window)
    at = starts[found[:, 0]] + found[:, 1]
    return np.concatenate((spans, np.stack((at, at + shape.window), axis=1)))


def _stage(batches: Iterator[pa.RecordBatch], shape: S.Shape, keep: bool) -> Iterator[pa.RecordBatch]:
    k = shape.window
    for batch in batches:
        out, held = [], 0
        whole, part, route, hot = (batch.column(c) for c in ("whole", "part", "route", "hot"))
        for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
            text = text.as_py()
            raw = _raw(text)
            if doc is None:
                spans = _own_repeats(raw, shape)
                out.append((*_result(doc, raw, H.spans_of(H.cover(len(raw), spans[:, 0], spans[:, 1] - spans[:, 0])), keep), *[None] * 5))
                continue
            h = H.byte_hashes(raw)
            at, g, seg, lo, hi, _ = shape.anchors(h, H.byte_hashes_again(raw))
            settled = _flagged(seg, whole[i].as_py()) | _late_twins(seg)
            gone = H.cover(len(raw), lo[settled], hi[settled] - lo[settled])
            some = _flagged(g, part[i].as_py()) & ~settled
            many = _flagged(g, hot[i].as_py()) & ~settled
            blocks, gone = _blocks(h, at[many], lo[many], hi[many], gone, k) if many.any() else ([], gone)
            spans = H.spans_of(gone)
            if not some.any() and not blocks:
                out.append((*_result(doc, raw, spans, keep), *[None] * 5))
            else:
                segs = _stretches(raw, g[some], lo[some], hi[some], part[i].as_py() or [], route[i].as_py() or [])
                who = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                out.append((doc, len(raw), None, None, None, None, text, who, spans.ravel().tolist(), segs, blocks))
            held += len(raw)
            if held > 16 << 20:
                yield _batch(out, _STAGE_ARROW)
                out, held = [], 0
        yield _batch(out, _STAGE_ARROW)


def _blocks(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, gone: np.ndarray, k: int) -> tuple[list[dict], np.ndarray]:
    """The windows around anchors that are met too often, in blocks of up to ``BLOCK`` neighbours; and ``gone`` with those that are late in their own document.

    Blocks are counted from the anchor, so that equal texts are cut alike.
    """
    starts = np.flatnonzero(H.cover(len(h), lo, hi - lo - k + 1)[: len(h) - k + 1])
    a, b = (H.signed(H.windows(h, k, lane)[starts]) for lane in (0, 1))
    again = _late_twins(a)
    gone = gone | H.cover(len(h), starts[again], k)
    a, b, starts = a[~again], b[~again], starts[~again]
    if not len(starts):
        return [], gone
    near = np.searchsorted(at, starts)
    part = (at[near] - starts) // BLOCK
    first = np.flatnonzero(np.concatenate(([True], (near[1:] != near[:-1]) | (part[1:] != part[:-1]) | (starts[1:] != starts[:-1] + 1))))
    ends = np.append(first[1:], len(starts))
    low, high = starts[first], starts[ends - 1] + k
    one, two = (H.signed(H.spans(h, low, high, lane)) for lane in (0, 1))
    # A block whose bytes go in any case is only listed for the others' sake.
    upto = np.concatenate(([0], np.cumsum(gone)))
    ask = upto[high] - upto[low] < high - low
    rows = zip(one.tolist(), two.tolist(), low.tolist(), high.tolist(), ask.tolist(), first.tolist(), ends.tolist())
    return [{"a": x, "b": y, "lo": s, "hi": e, "ask": q, "wa": a[i:j], "wb": b[i:j]} for x, y, s, e, q, i, j in rows], gone


def _stretches(raw: bytes, g: np.ndarray, lo: np.ndarray, hi: np.ndarray, part: list[int], route: list[int]) -> list[dict]:
    """The bytes around open anchors, those with one destination joined where they meet."""
    if not len(g):
        return []
    to = dict(zip(part, route))
    there = np.array([to[x] for x in H.signed(g).tolist()], dtype=np.int64)
    out = []
    for r in np.unique(there).tolist():
        mine = there == r
        a, b = lo[mine], np.maximum.accumulate(hi[mine])
        heads = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
        for x, y in zip(a[heads].tolist(), b[np.append(heads[1:], len(a)) - 1].tolist()):
            out.append({"g": r, "lo": x, "raw": raw[x:y]})
    return out


def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by route; whole routes are put together into buckets."""
    segs: list[bytes] = []
    keys: list[tuple[int, int, int]] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        docs, who, starts = np.array(keys, dtype=np.int64).T
        found = bwt.repeats(segs, docs, starts, length, who)
        of, at = found[:, 0], starts[found[:, 0]] + found[:, 1]
        order = np.lexsort((at, who[of], docs[of]))
        d, w, at = docs[of][order], who[of][order], at[order]
        first = np.ones(len(d), dtype=bool)
        first[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (at[1:] > at[:-1] + 1)
        heads = np.flatnonzero(first)
        ends = at[np.append(heads[1:], len(at)) - 1] + length if len(at) else at
        return pa.RecordBatch.from_arrays([pa.array(d[heads]), pa.array(w[heads]), pa.array(at[heads]), pa.array(ends)], schema=_SPAN_ARROW)

    for batch in batches:
        for g, doc, who, lo, raw in zip(*(batch.column(c).to_pylist() for c in ("g", "doc_id", "who", "lo", "raw"))):
            if g != last and size >= BUCKET:
                yield flush()
                segs, keys, size = [], [], 0
            last = g
            segs.append(raw)
            keys.append((doc, who, lo))
            size += len(raw) + 1
    if segs:
        yield flush()


def _close(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        hits = batch.column("hits")
        for i, (doc, text, covered) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("covered").to_pylist())):
            raw = _raw(text)
            more = [(x["lo"], x["hi"]) for x in hits[i].as_py() or []]
            spans = np.array([*np.array(covered or [], dtype=np.int64).reshape(-1, 2).tolist(), *more], dtype=np.int64).reshape(-1, 2)
            gone = H.cover(len(raw), spans[:, 0], spans[:, 1] - spans[:, 0])
            out.append(_result(doc, raw, H.spans_of(gone), keep))
        yield _batch(out, _DONE_ARROW)


def _late_windows(blocks: DataFrame, length: int) -> DataFrame:
    """Spans whose bytes a smaller doc_id holds too: whole blocks first, then the windows of those that are first of their kind."""

    def heads(rows: DataFrame, name: str) -> DataFrame:
        return W.bounded(W.store(rows.groupBy("a", "b").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail").drop("tail"), name))

    met = blocks.join(heads(blocks, "block-heads"), ["a", "b"], "left").withColumn("late", F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False)))
    met = W.store(met.where("ask or not late").select("doc_id", "who", "lo", "hi", "ask", "late", "wa", "wb"), "blocks")
    whole = met.where("late").select(F.col("doc_id").alias("hit_doc"), F.col("who").alias("hit_who"), "lo", "hi")
    windows = met.where("not late").select("doc_id", "who", "lo", "ask", F.posexplode(F.arrays_zip("wa", "wb")).alias("i", "w")).select("doc_id", "who", (F.col("lo") + F.col("i")).alias("lo"), "ask", F.col("w.wa").alias("a"), F.col("w.wb").alias("b"))
    single = windows.where("ask").join(heads(windows, "window-heads"), ["a", "b"]).where("doc_id > head").select(F.col("doc_id").alias("hit_doc"), F.col("who").alias("hit_who"), "lo", (F.col("lo") + length).alias("hi"))
    return whole.unionByName(single)


def dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep: bool = True) -> DataFrame:
    """Remove every byte in a ``length``-byte string that also starts earlier; ``keep`` adds what is left."""
    shape = S.Shape(length, min(gram, length), _items, _again)
    docs = documents.select("doc_id", "text")
    flags = S.flag_segments(S.segment_rows(docs, shape), S.heavy_anchors(docs, shape), hot=hot)
    staged = W.store(
        docs.join(S.by_document(flags), F.col("doc_id") == F.col("flag_doc"), "left").select("doc_id", "text", "whole", "part", "route", "hot").mapInArrow(lambda it: _stage(it, shape, keep), _STAGE_SCHEMA),
        "staged",
    )
    W.drop(flags)
    done = staged.where("text is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    todo = staged.where("text is not null")
    parts = W.shuffle_width(documents.sparkSession)  # a given number stays: few bytes are much work here
    segs = todo.select("doc_id", "who", F.explode("segs").alias("s")).select("doc_id", "who", "s.*").repartition(parts, "g").sortWithinPartitions("g")
    found = segs.mapInArrow(lambda it: _merge(it, length), _SPAN_SCHEMA)
    late = _late_windows(todo.select("doc_id", "who", F.explode("blocks").alias("b")).select("doc_id", "who", "b.*"), length)
    hits = found.unionByName(late).groupBy("hit_doc", "hit_who").agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))
    closed = todo.select("doc_id", "who", "text", "covered").join(hits, (F.col("doc_id") == F.col("hit_doc")) & (F.col("who") == F.col("hit_who")), "left").select("doc_id", "text", "covered", "hits").mapInArrow(lambda it: _close(it, keep), _DONE_SCHEMA)
    return done.unionByName(closed)
