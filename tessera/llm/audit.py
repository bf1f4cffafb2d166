"""Filter interaction audit: what five filters remove in every order, and how much each is worth.

A document fails a set of filters, its *mask*. For each part of the corpus the
counts of the 32 masks give the removal polynomial, the multilinear extension of
"documents removed by a set of filters":

    f(x) = sum over masks m of n(m) * (1 - prod over i in m of (1 - x_i))

with integer coefficients, one a set of filters. At a corner of the cube it is
the number of documents that the chosen filters remove, which gives the
survivors of every step of every order. Filter i's share over all orders is
its Shapley value, the integral of df/dx_i along the diagonal; it is taken in
exact rationals and scaled by 120, the number of orders.

Only masks and 128-bit digests of the texts are shuffled, never texts. Repeated
texts meet through the least ``doc_id`` of a digest, a partial aggregate, and
are joined back on digest and id together, so no group of copies sits in one task.

Defined results: a null text is an empty one and a null ``lang`` the part '';
an empty text fails A only (and E, where it is not the first); a row with a null
``doc_id`` has no smaller one and no label, so it never fails E and is nobody's
first; rows that share a ``doc_id`` are counted each, and do not repeat one
another; several labels of one id count if any of them says 1. Other columns
are ignored. An empty table has no parts and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _work as W

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = tuple(permutations(range(len(FILTERS))))
#: A fails under so many words; B under so many hundredths of distinct words; C over so many hundredths of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_NOT_CAPITAL = bytes(set(range(256)) - set(range(65, 91)))
_NOT_MARK = bytes(set(range(256)) - set(b"#$%&*|"))

_MASKS = "doc_id long, part string, mask int, d1 long, d2 long"
_MASKS_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])


def own_mask(raw: bytes, n_chars: int) -> int:
    """The filters A to D that a text fails, as bits."""
    words = raw.split()
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * len(raw.translate(None, _NOT_CAPITAL)) > MOST_CAPITALS * n_chars) << 2
        | bool(raw.translate(None, _NOT_MARK)) << 3
    )


def masks(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask of A to D, and a 128-bit digest of the text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            found, digests = [], []
            for raw, n in zip(texts.cast(pa.binary()), pc.utf8_length(texts).to_pylist()):
                raw = raw.as_py()
                found.append(own_mask(raw, n))
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.fill_null(b.column("lang"), ""), pa.array(found, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], schema=_MASKS_ARROW)

    return documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, _MASKS)


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of A to E, and how many documents, good ones and toxic ones have it."""
    rows = W.store(masks(documents), "masks")
    named = rows.where("doc_id is not null").groupBy("d1", "d2", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    firsts = rows.where("doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeats = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    judged = named.join(firsts, ["d1", "d2", "doc_id"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(repeats).alias("mask"), "n")
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    known = judged.join(said, "doc_id", "left").select("part", "mask", "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    none = F.lit(0).cast("long")
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), none.alias("good"), none.alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def removal_polynomial(counts: dict[int, int]) -> list[int]:
    """Coefficient of each set T of filters: (-1) ** (|T| + 1) times the documents that fail all of T."""
    out = [0] * SETS
    for t in range(1, SETS):
        out[t] = (-1) ** (t.bit_count() + 1) * sum(n for mask, n in counts.items() if mask & t == t)
    return out


def corners(polynomial: list[int]) -> list[int]:
    """The polynomial's value at every corner of the cube: documents that each set of filters removes."""
    return [sum(polynomial[t] for t in range(SETS) if t & s == t) for s in range(SETS)]


def diagonal_integral(polynomial: list[int], i: int) -> Fraction:
    """Integral from 0 to 1 of the partial derivative in x_i at (t, ..., t): a set T with i in it gives c_T * t ** (|T| - 1)."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(polynomial) if t >> i & 1), Fraction(0))


_ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_ROWS_ARROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])


def audit_part(part: str, cells: list[dict]) -> Iterator[tuple]:
    """The part's rows: every order, every step."""
    total = sum(c["n"] for c in cells)
    polynomials = {k: removal_polynomial({c["mask"]: c[k] for c in cells}) for k in ("n", "good", "toxic")}
    gone, good, toxic = (corners(polynomials[k]) for k in ("n", "good", "toxic"))
    every = SETS - 1
    worth = [diagonal_integral(polynomials["n"], i) * len(ORDERS) for i in range(len(FILTERS))]
    for order in ORDERS:
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield (part, name, step, total - gone[after], removed, gone[1 << i] - removed, gone[every] - gone[every & ~(1 << i)], good[after] - good[before], toxic[after] - toxic[before], int(worth[i]))
            before = after


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters, and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, cells in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                columns = zip(*audit_part(part, cells))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ROWS_ARROW)], schema=_ROWS_ARROW)

    # At most 32 masks a part.
    cells = mask_counts(documents, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(run, _ROWS)


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
masked AS (
  SELECT doc_id, part, (len(words) < 100)::INT
    + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(first < doc_id, false)::INT AS mask
  FROM worded),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masked LEFT JOIN said USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i::INT + 1, 1)), '') AS filter_order, s AS step,
    o[s] AS i, (1 << o[s]::INT) AS bit, coalesce(list_sum(list_transform(o[1:s - 1], lambda i: 1 << i::INT)), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s)),
rows AS (
  SELECT part, filter_order, step, i,
    sum(n * (mask & (before | bit) = 0)::INT) AS kept,
    sum(n * (mask & bit <> 0 AND mask & before = 0)::INT) AS removed,
    sum(n * (mask & bit <> 0 AND mask & before <> 0)::INT) AS redundant,
    sum(n * (mask = bit)::INT) AS unique_fails,
    sum(good * (mask & bit <> 0 AND mask & before = 0)::INT) AS good_lost,
    sum(toxic * (mask & bit <> 0 AND mask & before = 0)::INT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM rows
"""
