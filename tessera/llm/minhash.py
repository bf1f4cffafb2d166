"""Near-duplicate groups by circulant MinHash.

A document is the set of its distinct k-word shingles, each mapped by a first
permutation to a place in a ring of 2**32. Another permutation is laid on the
ring, and the j-th coordinate of the signature is its least value over the
set's places shifted by j: two permutations give every coordinate. Coordinates
are banded; documents that share a band are candidates, and candidates are
confirmed on their full sets, pivot by pivot (``_linking``).

With bands of ``ROWS`` coordinates a pair at the threshold 0.8 misses all
``BANDS`` with probability (1 - 0.8**4)**28 = 4e-7; more similar pairs less.

Defined results: null and wordless texts have an empty set and stay alone;
texts of fewer than k words are one shingle; a null ``doc_id`` is in no group
and kept; rows that share a ``doc_id`` are one document with the links of all
their sets (each row reports its own set's size). Ties go to the smallest
``doc_id``. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm import _linking as L
from tessera.llm import _work as W

BANDS, ROWS = 28, 4
#: Similarity of a link, in hundredths.
LINK = 80
_RING = np.uint32
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Hashes of the distinct k-word shingles, sorted; A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    h = H.word_hashes(words)
    return np.unique(H.windows(h, min(k, len(h)))) if len(h) else h


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of 32-bit integers: it deals shingles out over the ring."""
    x = x ^ (x >> _RING(16))
    x = x * _RING(0x7FEB352D)
    x = x ^ (x >> _RING(15))
    x = x * _RING(0x846CA68B)
    return x ^ (x >> _RING(16))


def _label(x: np.ndarray) -> np.ndarray:
    """The second permutation: the value at each place of the ring."""
    x = x ^ (x >> _RING(17))
    x = x * _RING(0xED5AD4BB)
    x = x ^ (x >> _RING(11))
    x = x * _RING(0xAC4C1B51)
    x = x ^ (x >> _RING(15))
    x = x * _RING(0x31848BAB)
    return x ^ (x >> _RING(14))


def signature(grams: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Least value of the second permutation over the set's places, for each of ``size`` shifts."""
    places = _scatter((grams >> np.uint64(32)).astype(_RING) ^ grams.astype(_RING) * _RING(0x9E3779B1))
    shifts = np.arange(size, dtype=_RING)[:, None]
    out = np.full(size, 0xFFFFFFFF, dtype=_RING)
    for at in range(0, len(places), 2048):
        out = np.minimum(out, _label(places[at : at + 2048][None, :] + shifts).min(axis=1))
    return out


def bands_of(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band."""
    parts = sig.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(parts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = H.mix64(key ^ parts[:, j])
    return key


_SIGNED = "doc_id long, n long, d1 long, d2 long, bands array<long>"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """Set size, 128-bit digest of the set, and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2, bands = [], [], [], []
            for t in b.column("text"):
                g = shingles(t.as_py(), k)
                n.append(len(g))
                one, two = L.digest(g)
                d1.append(one)
                d2.append(two)
                bands.append(H.signed(bands_of(signature(g))) if len(g) else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNED_ARROW)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SIGNED)


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different sets, and the buckets of those that share a band."""
    nodes = L.nodes_of(signed, F.first("bands").alias("bands"))
    return nodes, L.buckets_of(nodes.select("node", F.explode("bands").alias("key")), nodes)


def groups(documents: DataFrame, k: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return L.components_of_rows(*linked(documents, k))


def linked(documents: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's set (doc_id, n, d1, d2), the different sets, and the component of each that has links; all stored."""
    signed = W.store(signatures(documents, k), "signatures")
    nodes, buckets = candidates(signed)
    wanted = buckets.select("node").distinct().join(nodes.select("node", "rep", "d1"), "node")
    sets = L.sets_of(documents, wanted, shingles, k)
    roots = L.link(buckets, sets, LINK, L.same_document(signed, nodes))
    return signed, nodes, roots


def keep_one(documents: DataFrame, k: int) -> DataFrame:
    """The rows without near duplicates: of each group of linked texts the one with the smallest ``doc_id`` stays.

    Here every text stands for itself: rows that share a ``doc_id`` are linked
    only where their texts are similar. Rows with a null ``doc_id`` or without
    words stay. Of rows that repeat an id and a text, one stays.
    """
    signed = W.store(signatures(documents, k), "signatures")
    nodes, buckets = candidates(signed)
    wanted = buckets.select("node").distinct().join(nodes.select("node", "rep", "d1"), "node")
    roots = L.link(buckets, L.sets_of(documents, wanted, shingles, k), LINK)
    placed = nodes.join(roots, F.col("node") == F.col("id"), "left").select("d1", "d2", "rep", F.coalesce("root", "node").alias("root"))
    keepers = placed.groupBy("root").agg(F.min(F.struct("rep", "d1", "d2")).alias("k")).select(F.col("k.rep").alias("doc_id"), "k.d1", "k.d2")
    keepers = W.store(keepers, "keepers")
    named = signed.where("doc_id is not null")
    shared = W.store(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared")
    lost = W.store(named.where("n > 0").select("doc_id", "d1", "d2").join(keepers, ["doc_id", "d1", "d2"], "left_anti").select("doc_id").distinct(), "lost")
    if not shared.limit(1).count():
        return W.with_ids(documents, lost, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            sets = [shingles(t, k) for t in texts]
            said = [hashlib.sha256(t.encode()).hexdigest() if t is not None else "" for t in texts]
            one, two = zip(*map(L.digest, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(said), pa.array([len(g) for g in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["doc_id", "said", "n", "d1", "d2"])

    several = W.with_ids(documents, shared, "left_semi")
    texts = several.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, said string, n long, d1 long, d2 long")
    stay = texts.where("n > 0").join(keepers, ["doc_id", "d1", "d2"], "left_semi").groupBy("doc_id", "d1", "d2").agg(F.min("said").alias("said")).select("doc_id", "said")
    stay = W.store(stay.unionByName(texts.where("n = 0").select("doc_id", "said").distinct()).select(F.col("doc_id").alias("stay_id"), F.col("said").alias("stay_text")), "stay")
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    said = F.when(F.col("text").isNull(), "").otherwise(F.sha2("text", 256))
    rows = several.select(whole.alias("r"), F.col("doc_id").alias("in_id"), said.alias("in_text"))
    rows = rows.join(W.bounded(stay), (F.col("in_id") == F.col("stay_id")) & (F.col("in_text") == F.col("stay_text")))
    one = rows.groupBy("in_id", "in_text").agg(F.min_by("r", F.to_json("r")).alias("r")).select("r.*")
    plain = W.with_ids(documents, W.store(lost.unionByName(shared).distinct(), "lost-or-shared"), "left_anti")
    return plain.unionByName(one.select(*(F.col(f"`{c}`") for c in documents.columns)))
