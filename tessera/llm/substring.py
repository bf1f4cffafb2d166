"""Substring dedup by a log-structured index of window fingerprints.

Documents arrive in batches of ascending ``doc_id``. Each batch is reduced to
the fingerprints of its anchor windows (see ``_segments``), which are
merge-joined with the sorted immutable runs of earlier batches. What meets is
verified: windows of ``window`` words are compared by two 64-bit digests, each
from word hashes of its own; for that the index keeps the texts of the documents
its runs point to. The batch then becomes a run itself, and runs are compacted
into one when more than ``fan_in`` of them lie there. Batches that are added in
one call, in many, or by another session that opens the same folder give the
same results.

Defined results: a null or blank text has no words and loses none; documents of
fewer than ``window`` words lose none; rows with a null ``doc_id`` are measured
and kept as they are; rows that share a ``doc_id`` never repeat each other; of
equal windows the smallest ``doc_id`` keeps its words; a document of an earlier
batch is never changed by a later one. Other columns of the input are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm import _segments as S
from tessera.llm import _work as W

WINDOW, GRAM = 50, 20

#: Hash key of the second digest's words.
SECOND = "tessera-second-w"

RUN_SCHEMA = "g long, sh long, core long, doc_id long"


def _items(text: str | None) -> np.ndarray:
    return H.word_hashes(H.words_of(text))


class FingerprintIndex:
    """Sorted immutable runs of historical window fingerprints, and the texts they come from, under one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, fan_in: int = 4):
        self.spark, self.fan_in = spark, fan_in
        self.path = path or W.new_path(spark, "fingerprints")
        self.shape = S.Shape(window, min(gram, window), _items)

    def _finished(self, kind: str) -> list[str]:
        """Folders with a success marker, oldest first; one without is a lost attempt."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(kind)]
        return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def runs(self) -> list[str]:
        return self._finished("run-")

    def read(self) -> DataFrame | None:
        runs = self.runs()
        return self.spark.read.schema(RUN_SCHEMA).parquet(*runs) if runs else None

    def texts(self) -> DataFrame | None:
        """doc_id and text of every document that a run points to, and maybe of some more."""
        found = self._finished("text-")
        return self.spark.read.schema("doc_id long, text string").parquet(*found) if found else None

    def _next(self) -> int:
        return max((int(r.rsplit("-", 1)[1]) for r in self.runs() + self._finished("text-")), default=-1) + 1

    def _write(self, rows: DataFrame, number: int) -> None:
        rows.select("g", "sh", "core", "doc_id").repartitionByRange(W.shuffle_width(self.spark), "g", "sh").sortWithinPartitions("g", "sh", "doc_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/run-{number:06d}")

    def add(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """Dedup a batch against itself and all earlier ones: doc_id, n_words, n_removed, kept_sha256, kept.

        Unless ``keep`` is false, later batches will see this one: its texts are
        written first and its run last, so a lost call leaves no half batch.
        """
        batch = batch.select("doc_id", "text")
        history = self.read()
        rows = W.store(S.segment_rows(batch, self.shape), "segments")
        flags = S.flag_segments(rows, S.heavy_anchors(batch, self.shape, history), history=None if history is None else history.withColumn("at", F.lit(0).cast("long")))
        out = self._verify(batch, flags)
        if keep:
            number, new = self._next(), rows.where(~F.col("settled"))
            ids = W.store(new.select("doc_id").distinct(), "ids")
            W.with_ids(batch, ids, "left_semi").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/text-{number:06d}")
            self._write(new, number)
            W.drop(ids)
            if len(self.runs()) > self.fan_in:
                self.compact()
        W.drop(rows)
        return out

    def compact(self) -> None:
        """Merge all runs into one; of equal fingerprints the smallest document stays."""
        old = self.runs()
        if len(old) < 2:
            return
        self._write(self.read().groupBy("g", "sh", "core").agg(F.min("doc_id").alias("doc_id")), self._next())
        for run in old:
            W.drop_path(self.spark, run)

    def _verify(self, batch: DataFrame, flags: DataFrame) -> DataFrame:
        """Windows that are still in question, of this batch and of the documents they may repeat, compared by their digests."""
        shape = self.shape
        staged = (
            batch.join(S.by_document(flags), F.col("doc_id") == F.col("flag_doc"), "left")
            .select("doc_id", "text", "whole", "part")
            .mapInArrow(lambda it: _stage(it, shape), _STAGE_SCHEMA)
        )
        staged = W.store(staged, "staged")
        done = staged.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
        open_rows = staged.where("text is not null")
        seen = open_rows.select("doc_id", F.explode("w").alias("w")).select("doc_id", "w.*")
        texts, every = self.texts(), seen
        if texts is not None:
            past = flags.where("kind = 1").join(self.read().select(F.col("doc_id").alias("held_id")).distinct(), F.col("doc_id") == F.col("held_id"), "left_semi")
            past = W.store(past.groupBy(F.col("doc_id").alias("flag_doc")).agg(F.collect_list("id").alias("part")), "past")
            held = W.with_ids(texts, past.select("flag_doc"), "left_semi").join(past, F.col("doc_id") == F.col("flag_doc"))
            every = every.unionByName(held.select("doc_id", "text", "part").mapInArrow(lambda it: _past_windows(it, shape), "doc_id long, a long, b long"))
        heads = every.groupBy("a", "b").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail").drop("tail")
        heads = W.store(heads, "window-heads")
        again = seen.join(W.bounded(heads), ["a", "b"]).where("head < doc_id").groupBy(F.col("doc_id").alias("hit_doc")).agg(F.collect_set("a").alias("hits"))
        W.drop(flags)
        closed = (
            open_rows.join(again, F.col("doc_id") == F.col("hit_doc"), "left")
            .select("doc_id", "text", "covered", "hits")
            .mapInArrow(lambda it: _close(it, shape), _DONE_SCHEMA)
        )
        return done.unionByName(closed)


_STAGE_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, text string, covered array<int>, w array<struct<a:long,b:long>>"
_STAGE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("text", pa.string()), ("covered", pa.list_(pa.int32())), ("w", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])
_DONE_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_DONE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _result(doc, words: list[bytes], gone: np.ndarray | None) -> tuple:
    kept = words if gone is None or not gone.any() else [w for w, x in zip(words, gone.tolist()) if not x]
    raw = b" ".join(kept)
    return doc, len(words), len(words) - len(kept), hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "surrogatepass")


def _flagged(g: np.ndarray, wanted) -> np.ndarray:
    if not wanted:
        return np.zeros(len(g), dtype=bool)
    if len(g) > 512:
        return np.isin(g, np.array(wanted, dtype=np.int64).view(np.uint64))
    kinds = set(wanted)  # quicker than sorting a few
    return np.fromiter((x in kinds for x in H.signed(g).tolist()), dtype=bool, count=len(g))


def _digests(words: list[bytes], h: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Both digests of the windows that start there."""
    return H.signed(H.windows(h, k)[starts]), H.signed(H.windows(H.word_hashes(words, SECOND), k, 1)[starts])


def _past_windows(batches: Iterator[pa.RecordBatch], shape: S.Shape) -> Iterator[pa.RecordBatch]:
    """The windows around flagged anchors of earlier documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        part = batch.column("part")
        for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
            words = H.words_of(text)
            h = H.word_hashes(words)
            n, k = len(words), shape.window
            _, g, _, lo, hi, _ = shape.anchors(h)
            some = _flagged(g, part[i].as_py())
            starts = np.flatnonzero(H.cover(n, lo[some], hi[some] - lo[some] - k + 1)[: max(n - k + 1, 0)])
            a, b = _digests(words, h, starts, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), doc, dtype=np.int64)), pa.array(a), pa.array(b)], schema=schema)


def _stage(batches: Iterator[pa.RecordBatch], shape: S.Shape) -> Iterator[pa.RecordBatch]:
    """Apply what is settled; list the windows that are still open."""
    for batch in batches:
        out = []
        whole, part = batch.column("whole"), batch.column("part")
        for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
            text = text.as_py()
            words = H.words_of(text)
            full, some = whole[i].as_py(), part[i].as_py()
            if not full and not some:
                out.append((*_result(doc, words, None), None, None, None))
                continue
            h = H.word_hashes(words)
            at, g, seg, lo, hi, _ = shape.anchors(h)
            n, k = len(words), shape.window
            settled = _flagged(seg, full)
            gone = H.cover(n, lo[settled], hi[settled] - lo[settled])
            pieces = _flagged(g, some) & ~settled
            if not pieces.any():
                out.append((*_result(doc, words, gone), None, None, None))
                continue
            # Window starts inside an open segment whose windows are not settled already.
            mark = H.cover(n, lo[pieces], hi[pieces] - lo[pieces] - k + 1)[: n - k + 1]
            mark &= ~H.cover(n, lo[settled], hi[settled] - lo[settled] - k + 1)[: n - k + 1]
            a, b = _digests(words, h, np.flatnonzero(mark), k)
            spans = H.spans_of(gone).astype(np.int32).ravel().tolist()
            out.append((doc, n, int(gone.sum()), None, None, text, spans, [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())]))
        yield _batch(out, _STAGE_ARROW)


def _close(batches: Iterator[pa.RecordBatch], shape: S.Shape) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        hits = batch.column("hits")
        for i, (doc, text, spans) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("covered").to_pylist())):
            words = H.words_of(text)
            gone = np.zeros(len(words), dtype=bool)
            for lo, hi in np.array(spans or [], dtype=np.int64).reshape(-1, 2):
                gone[lo:hi] = True
            found = hits[i].as_py()
            if found:
                h = H.word_hashes(words)
                starts = np.flatnonzero(_flagged(H.windows(h, shape.window), found))
                gone |= H.cover(len(words), starts, shape.window)
            out.append(_result(doc, words, gone))
        yield _batch(out, _DONE_ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def dedup(documents: DataFrame, window: int = WINDOW, batches: int = 3, index: FingerprintIndex | None = None) -> DataFrame:
    """Remove every word in a window of ``window`` words that also starts in a smaller doc_id.

    The documents go to the index in ``batches`` ranges of ``doc_id``. An index
    of one's own keeps them all; else nothing is kept of the last batch.
    """
    spark = documents.sparkSession
    own = index is not None
    index = index or FingerprintIndex(spark, window=window, fan_in=1)
    cuts = sorted(set(documents.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("q")).first()["q"] or [])) if batches > 1 else []
    out = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = documents
        if low is not None:
            batch = batch.where((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        out.append(index.add(batch, keep=own or high is not None))
    return functools.reduce(DataFrame.unionByName, out)
