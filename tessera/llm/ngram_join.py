"""Self-join of documents on the Jaccard similarity of their word shingles, by token-combination prefixes.

A document is the set x of its distinct k-word shingles, its *tokens*, in one
order for all documents: rare before frequent. With n = |x| and T hundredths,
at most d = n * (100 - T) / 100 tokens of x miss in a similar y, and the two
sets differ in at most D = n * (100 - T) / T tokens. Let r be x's tokens of the
*rare* class, at most ``RARE`` documents each.

* If the first common token is rare, it lies among x's first d + 1 tokens, and
  among y's: these are indexed one by one.
* If not, no rare token is common, and the budgets shrink to d - r and D - r.
  Of the frequent tokens the prefix is extended until two common ones must
  stand side by side in both sets: each gap between common tokens that is not
  clean uses up one of D - r differences, so two neighbours lie among the first
  (D - r) + (d - r) + 2. Combinations of neighbouring tokens are indexed. This
  is linear in the prefix, where all pairs would be its square.

Candidates are verified on full sets (``_linking``): no link is lost.

Token counts need a shuffle of tokens, so they are kept small. Only a quarter
of the shingles, by hash, is counted and comes first in the order; the prefix
rarely reaches the others, which are in the frequent class. Sets of up to
``SHORT`` tokens are too small for that: they have an index of their own in
which all shingles are counted. Sets that may be similar share an index (those
between are in both). A counted token that one set alone has can be in no link,
so a set with more than d of them in each of its indexes is left out at once.

The more tasks share the tokens, the fewer of a set's own tokens meet in one.
They move as ``KEY_BITS`` bits of the set's digest, sorted and packed as
differences, about two bytes each in a table of any size; sets that agree in
these bits are not left out. Of the sets that stay, only the uncounted tokens
that a prefix may reach move to their counts, never whole sets.

Defined results: null and wordless texts have an empty set and are linked with
nothing; texts of fewer than k words are one shingle; a null ``doc_id`` is in
no link; rows that share a ``doc_id`` are one document with the links of all
their sets (each row reports its own set's size). Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm import _linking as L
from tessera.llm import _work as W
from tessera.llm.minhash import shingles

WORDS, LINK = 4, 85
#: Rows that may have a token of the rare class.
RARE = 64
#: Of the long index one token in so many is counted.
COUNTED = 4
#: Sets of the short index; those that may also be similar to larger sets are in both.
SHORT = 117
#: Tokens that a task folds together.
FOLDED = 2 << 20
#: Bits of a digest by which a set's own tokens are counted.
KEY_BITS = 32


def long_from(link: int = LINK, short: int = SHORT) -> int:
    """Size from which sets are in the long index: any smaller one's partners are all in the short index."""
    return short * link // 100 + 1


def is_counted(grams: np.ndarray) -> np.ndarray:
    return grams % np.uint64(COUNTED) == 0


def token_keys(grams: np.ndarray, long_index: bool) -> np.ndarray:
    """What a shingle is called in either index: the last bit is the index."""
    return (H.mix64(grams) & ~np.uint64(1)) | np.uint64(long_index)


_SIGNED = "doc_id long, n long, d1 long, d2 long, grams binary"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("grams", pa.binary())])


def sign(documents: DataFrame, k: int = WORDS) -> DataFrame:
    """Set size, 128-bit digest and the counted shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column("text")]
            one, two = zip(*map(L.digest, sets)) if sets else ((), ())
            kept = [(g if len(g) <= SHORT else g[is_counted(g)]).tobytes() for g in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(g) for g in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(kept, pa.binary())], schema=_SIGNED_ARROW)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SIGNED)


def least_to_link(link: int) -> int:
    """Tokens of the smallest set that may be similar to another one."""
    n = 1
    while 100 * n < link * (n + 1):
        n += 1
    return n


def token_rows(signed: DataFrame, link: int = LINK) -> DataFrame:
    """(token, lo, hi, n): in either index, the least and the greatest digest (null if they are equal) of the sets that have a token, and in how many rows; folded within the task."""
    least, from_ = least_to_link(link), long_from(link)
    schema = pa.schema([("token", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def fold() -> pa.RecordBatch:
            t, d = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(t, kind="stable")
            t, d = t[order], d[order]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            n = np.diff(np.append(first, len(t)))
            lo, hi = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
            return pa.RecordBatch.from_arrays([pa.array(H.signed(t[first])), pa.array(lo), pa.array(hi, mask=lo == hi), pa.array(n.astype(np.int64))], schema=schema)

        for b in batches:
            for n, d1, raw in zip(b.column("n").to_pylist(), b.column("d1").to_pylist(), b.column("grams")):
                grams = np.frombuffer(raw.as_py(), dtype=np.uint64)
                parts = [token_keys(grams, False)] if n <= SHORT else []
                if n >= from_:
                    parts.append(token_keys(grams[is_counted(grams)], True))
                for t in parts:
                    if len(t):
                        held.append((t, np.full(len(t), d1, dtype=np.int64)))
                        size += len(t)
                if size >= FOLDED:
                    yield fold()
                    held, size = [], 0
        if held:
            yield fold()

    return signed.where((F.col("n") >= least) & F.col("doc_id").isNotNull()).select("n", "d1", "grams").mapInArrow(run, "token long, lo long, hi long, n long")


def packed(keys: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit integers as differences, by planes of bytes: those of close ones compress."""
    return np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def told_of(rows: DataFrame, bits: int) -> DataFrame:
    """(token, times, part, own) of token rows: the tokens that several sets have; and by parts of the keys and the index (the last bit), the packed keys of the sets that tokens have to themselves. Stored."""
    parts = min(bits, (W.shuffle_width(rows.sparkSession) // 4).bit_length())
    # Rows are folded already: they are dealt out as they are, without their hi.
    seen = rows.repartition("token").groupBy("token").agg(F.min("lo").alias("lo"), F.max(F.coalesce("hi", "lo")).alias("hi"), F.sum("n").alias("n"))
    fields = [("token", pa.int64()), ("times", pa.int64()), ("part", pa.int64()), ("own", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def fold() -> pa.RecordBatch:
            # The index comes first, then the key: parts are runs.
            all_ = np.sort(np.concatenate(held))
            part = (all_ >> np.uint64(bits - parts)).astype(np.int64)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            low = (all_ & np.uint64((1 << bits) - 1)).astype(np.uint32)
            index, of = part[first] >> parts, part[first] & ((1 << parts) - 1)
            nothing = pa.nulls(len(first), pa.int64())
            return pa.RecordBatch.from_arrays([nothing, nothing, pa.array(of * 2 + index), pa.array([packed(k) for k in np.split(low, first[1:])], pa.binary())], schema=pa.schema(fields))

        for b in batches:
            token, lo, hi, n = (b.column(c).to_numpy() for c in ("token", "lo", "hi", "n"))
            several = lo < hi
            many = int(several.sum())
            yield pa.RecordBatch.from_arrays([pa.array(token[several]), pa.array(n[several]), pa.nulls(many, pa.int64()), pa.nulls(many, pa.binary())], schema=pa.schema(fields))
            alone = ~several
            held.append((lo[alone].view(np.uint64) >> np.uint64(64 - bits)) | ((token[alone] & 1).view(np.uint64) << np.uint64(bits)))
            size += int(alone.sum())
            if size >= FOLDED:
                yield fold()
                held, size = [], 0
        if size:
            yield fold()

    return W.store(seen.mapInArrow(run, "token long, times long, part long, own binary"), "tokens")


def own_of(told: DataFrame) -> DataFrame:
    """(key, long_index, own): how many tokens the sets of a key have to themselves in either index."""
    schema = pa.schema([("key", pa.int64()), ("long_index", pa.int32()), ("own", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []

        def count() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.full(len(keys), of & 1, dtype=np.int32)), pa.array(n.astype(np.int64))], schema=schema)

        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("own")):
                if part != of and held:
                    yield count()
                    held = []
                of = part
                held.append(unpacked(raw.as_py()))
        if held:
            yield count()

    return told.where("part is not null").select("part", "own").repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, long_index int, own long")


def bounds(n: int, link: int) -> tuple[int, int]:
    """d and D of a set of n tokens."""
    return n * (100 - link) // 100, n * (100 - link) // link


def uncounted(grams: np.ndarray, long_index: bool, link: int) -> np.ndarray:
    """A set's tokens without a count, in order, as far as a prefix may reach."""
    return np.sort(token_keys(grams[~is_counted(grams)], True))[: sum(bounds(len(grams), link)) + 2] if long_index else np.empty(0, dtype=np.uint64)


def keys_of(n: int, own: int, known: np.ndarray, times: np.ndarray, rest: np.ndarray, link: int, rare: int) -> np.ndarray:
    """Index keys of a set of n tokens: single tokens of the rare class, combinations of neighbours of the frequent one.

    ``own`` of its counted tokens are its alone, the ``known`` ones are in ``times`` rows; ``rest`` are the first of those without a count.
    """
    d, diff = bounds(n, link)
    order = np.lexsort((known, times))
    known, times = known[order], times[order]
    r = own + int((times <= rare).sum())
    single = known[: max(0, min(r, d + 1) - own)]
    if r > d:
        return single
    frequent = np.concatenate((known[r - own :], rest))[: (diff - r) + (d - r) + 2]
    return np.concatenate((single, H.mix64(frequent[:-1] ^ H.mix64(frequent[1:] + np.uint64(0x632BE59BD9B4E019)))))


def prefix_keys(grams: np.ndarray, counts: dict[int, int], long_index: bool, link: int, rare: int) -> np.ndarray:
    """Index keys of a whole set; ``counts`` holds the counted tokens that several sets have."""
    tokens = token_keys(grams[is_counted(grams)] if long_index else grams, long_index)
    times = np.array([counts.get(t, 0) for t in H.signed(tokens).tolist()], dtype=np.int64)
    known = times > 0
    return keys_of(len(grams), int((~known).sum()), tokens[known], times[known], uncounted(grams, long_index, link), link, rare)


def candidates(documents: DataFrame, signed: DataFrame, k: int = WORDS, link: int = LINK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The different sets, the buckets of those that share a key, and the full sets of all that have keys."""
    least, from_, rare = least_to_link(link), long_from(link), RARE
    nodes = L.nodes_of(signed)
    bits = KEY_BITS
    told = told_of(token_rows(signed, link), bits)
    shared, own = told.where("part is null").select("token", "times"), own_of(told)
    # A set is open unless it has more than d tokens of its own in each of its indexes.
    fits = F.when(F.col("long_index") == 0, F.col("n") <= SHORT).otherwise(F.col("n") >= from_)
    large = nodes.where(F.col("n") >= least).withColumn("key", F.shiftrightunsigned("d1", 64 - bits))
    twins = W.store(large.groupBy("key").count().where("count > 1").select(F.col("key").alias("twin")), "twins")
    both = large.select("node", "rep", "n", "d1", "key", F.explode(F.array(F.lit(0), F.lit(1))).alias("long_index")).where(fits)
    few = (100 * F.coalesce("own", F.lit(0)) <= (100 - link) * F.col("n")) | F.col("twin").isNotNull()
    opened = both.join(own, ["key", "long_index"], "left").join(W.bounded(twins), F.col("key") == F.col("twin"), "left").where(few)
    sets = L.sets_of(documents, W.store(opened.select("node", "rep", "d1").distinct(), "open"), shingles, k)

    def indexes(n: int) -> list[bool]:
        return [False] * (n <= SHORT) + [True] * (n >= from_)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, raw in zip(b.column("node").to_pylist(), b.column("grams")):
                grams = np.frombuffer(raw.as_py(), dtype=np.uint64)
                for index in indexes(len(grams)):
                    t = token_keys(grams[is_counted(grams)] if index else grams, index)
                    out.append((H.signed(t), np.full(len(t), node, dtype=np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["token", "node"])

    rest_schema = pa.schema([("node", pa.int64()), ("long_index", pa.int32()), ("n", pa.int64()), ("counted", pa.int64()), ("rest", pa.binary())])

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, raw in zip(b.column("node").to_pylist(), b.column("grams")):
                grams = np.frombuffer(raw.as_py(), dtype=np.uint64)
                for index in indexes(len(grams)):
                    out.append((node, int(index), len(grams), int(is_counted(grams).sum()) if index else len(grams), uncounted(grams, index, link).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), rest_schema)], schema=rest_schema)

    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, n, counted, raw, t, times in zip(*(b.column(c).to_pylist() for c in ("node", "n", "counted", "rest", "tokens", "times"))):
                known = np.array(t or (), dtype=np.int64).view(np.uint64)
                got = np.unique(keys_of(n, counted - len(known), known, np.array(times or (), dtype=np.int64), np.frombuffer(raw, dtype=np.uint64), link, rare))
                out.append((H.signed(got), np.full(len(got), node, dtype=np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    mine = sets.mapInArrow(tokens, "token long, node long").join(shared, "token")
    # A set's own tokens, never more than its text has.
    listed = mine.groupBy("node", F.col("token").bitwiseAND(1).cast("int").alias("long_index")).agg(F.collect_list("token").alias("tokens"), F.collect_list("times").alias("times"))
    held = sets.mapInArrow(rests, "node long, long_index int, n long, counted long, rest binary")
    indexed = W.store(held.join(listed, ["node", "long_index"], "left").mapInArrow(keys, "key long, node long"), "index")
    W.drop(told)
    return nodes, L.buckets_of(indexed, nodes), sets


def link_documents(documents: DataFrame, k: int = WORDS, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest ``doc_id`` that links reach."""
    signed = W.store(sign(documents, k), "signed")
    nodes, buckets, sets = candidates(documents, signed, k, link)
    roots = L.link(buckets, sets, link, L.same_document(signed, nodes))
    return L.components_of_rows(signed, nodes, roots).drop("kept")
