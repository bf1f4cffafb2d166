"""Cross-tokenizer alignment: which tokens of two tokenizers hold the same bytes.

Both tokenizers cut the same bytes, so either's tokens tile them. B's tokens are
a static interval index, two sorted arrays of starts and ends; each A token
stabs it by bisection, and what lies between the two answers are the B tokens
that it overlaps, its *links*. A place between two A tokens that no B token
spans, which is where the second's first link lies behind the first's last, is
a group's boundary. Texts are tokenised once and aligned many at a time, laid
end to end; the places between them are boundaries by themselves.

How many documents link a pair of ids is counted in each task first. Both
vocabularies have less than 2**16 ids, so A's best counts are a small table. The
counts go back to the documents in two ways that together cover every pair:
the most frequent ones, at most ``HEAD`` of them, are shipped, and all others
are joined, with none of them frequent.

Defined results: null and empty texts, and texts whose tokens' bytes are not a
space and the text (B takes U+2581 for a space), have no tokens: zeros and an
empty string. Strings of special tokens are plain text. A null ``doc_id`` stays
null and rows that share one are documents of their own. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _work as W

#: Pairs that are shipped to every task, with 17 bytes each; the others are joined.
HEAD = 1 << 20
#: Characters that are aligned at a time, and pair ids that a task counts at a time.
CHUNK, COUNTED = 1 << 20, 4 << 20
_BITS = 16

#: Texts that both libraries for A certainly cut alike: Latin letters, no long run of white space (the rank library's pattern recurses there).
_PLAIN = re.compile("(?:[!-~¡-ÿ‐-‧]+|[\t-\r ]{1,64}(?![\t-\r ]))*")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, then from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Sides:
    """Both tokenizers, and their tokens' bytes."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a)
        self.slow.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = {t: i for t, i in self.slow.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.fast = self._ranks(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << _BITS:
            raise ValueError(f"vocabularies of at most {1 << _BITS} ids are wanted")
        self.a_len, self.b_len = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        text = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        self.a_inner, self.a_last = text(len(self.a_bytes), ","), text(len(self.a_bytes), "|")
        self.b_inner, self.b_last = text(len(self.b_bytes), ","), text(len(self.b_bytes), ";")

    def _ranks(self, path: str):
        """The same tokenizer by ranks, which is several times faster; none if the file's merges are not in the order of its ids."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, cut = said["model"], said["pre_tokenizer"] or {}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        alike = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and said["normalizer"] is None and not model.get("ignore_merges")
        if not alike or any(model["vocab"].get(t) != 256 + i for i, t in enumerate(merged)):
            return None
        ranks = {t: i for i, t in enumerate(self.a_bytes) if t}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """Ids of A and B, if both hold a space and the text."""
        if not text:
            return None
        whole = " " + text
        raw = whole.encode()
        a = self.fast.encode_ordinary(whole) if self.fast and _PLAIN.fullmatch(text) else self.slow.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(text)
        if b"".join([self.b_bytes[i] for i in b]) != raw or b"".join([self.a_bytes[i] for i in a]) != raw:
            return None
        return a, b


@cache
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


class Overlaps:
    """Links and groups of tokens that tile the same bytes, of several texts end to end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray):
        self.a, self.b = a, b
        a_end, b_end = np.cumsum(a_len[a]), np.cumsum(b_len[b])
        self.first = np.searchsorted(b_end, a_end - a_len[a], side="right")
        self.behind = np.searchsorted(b_end - b_len[b], a_end, side="left")
        #: Whether a group ends behind each A token: the next one's first link is none of its own.
        self.cut = np.append(self.behind[:-1] <= self.first[1:], True)
        self.a_behind = np.flatnonzero(self.cut) + 1
        self.b_behind = self.behind[self.cut]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and the B token of every link."""
        n = self.behind - self.first
        at = np.repeat(np.arange(len(self.a)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n - self.first, n)

    def stream(self, s: Sides) -> np.ndarray:
        """Every token's id and the sign behind it, group by group."""
        group_a = np.cumsum(self.cut) - self.cut
        group_b = np.searchsorted(self.b_behind, np.arange(len(self.b)), side="right")
        ends = np.zeros(len(self.b), dtype=bool)
        ends[self.b_behind - 1] = True
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        out[np.arange(len(self.a)) + np.append(0, self.b_behind[:-1])[group_a]] = np.where(self.cut, s.a_last[self.a], s.a_inner[self.a])
        out[np.arange(len(self.b)) + self.a_behind[group_b]] = np.where(ends, s.b_last[self.b], s.b_inner[self.b])
        return out


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
_ALIGNED_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def _align_some(texts: list[str | None], s: Sides) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups, distinct pairs (A's id in the upper bits) and how often each is linked, of each text."""
    out: list[tuple] = [(0, 0, 0, 0, "", b"", b"")] * len(texts)
    ids = [(i, x) for i, x in enumerate(map(s.encode, texts)) if x]
    if not ids:
        return out
    a = np.concatenate([np.array(x[0], dtype=np.int64) for _, x in ids])
    b = np.concatenate([np.array(x[1], dtype=np.int64) for _, x in ids])
    a_to, b_to = (np.cumsum([len(x[k]) for _, x in ids]) for k in (0, 1))
    o = Overlaps(a, b, s.a_len, s.b_len)
    at, to = o.links()
    doc = np.repeat(np.arange(len(ids)), np.diff(a_to, prepend=0))
    pairs, times = np.unique((doc[at] << 2 * _BITS) | (a[at] << _BITS) | b[to], return_counts=True)
    pair_to = np.searchsorted(pairs, np.arange(1, len(ids) + 1) << 2 * _BITS)
    pairs, times = (pairs & ((1 << 2 * _BITS) - 1)).astype("<u4"), times.astype("<u4")
    n_links, n_groups = np.bincount(doc[at], minlength=len(ids)), np.bincount(doc[o.cut], minlength=len(ids))
    stream = o.stream(s).tolist()
    was = (0, 0, 0)
    for k, (i, _) in enumerate(ids):
        now = (int(a_to[k]), int(b_to[k]), int(pair_to[k]))
        groups = "".join(stream[was[0] + was[1] : now[0] + now[1]])[:-1]
        own = slice(was[2], now[2])
        out[i] = (now[0] - was[0], now[1] - was[1], int(n_groups[k]), int(n_links[k]), groups, pairs[own].tobytes(), times[own].tobytes())
        was = now
    return out


def align(documents: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Per document: a number of its own, counts, its groups as text, its distinct pairs of ids and how often it links each."""
    if a is None or b is None:
        a, b = (x or y for x, y in zip((a, b), default_tokenizers()))
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        s = sides(a, b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < len(texts):
                some, size, first = [], 0, at
                while at < len(texts) and size < chunk:
                    some.append(texts[at].as_py())
                    size += len(some[-1] or "")
                    at += 1
                columns = zip(*_align_some(some, s))
                numbers = pa.array(np.arange(row, row + len(some)))
                yield pa.RecordBatch.from_arrays([numbers, docs.slice(first, len(some)), *(pa.array(c, type=f.type) for c, f in zip(columns, list(_ALIGNED_ARROW)[2:]))], schema=_ALIGNED_ARROW)
                row += len(some)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n and best: how many documents link each pair of ids, and whether that is the most of its A id; stored."""
    counted = COUNTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

        def fold() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held])
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], n[order]
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            return pairs[first], np.add.reduceat(n, first)

        for batch in batches:
            for raw in batch.column("pairs"):
                got = np.frombuffer(raw.as_py(), dtype="<u4")
                if len(got):
                    held.append((got, np.ones(len(got), dtype=np.int64)))
                    size += len(got)
                if size >= counted:
                    held, size = [fold()], 0
                    if len(held[0][0]) >= counted:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], schema=schema)
                        held = []
        if held:
            pairs, n = fold()
            for i in range(0, len(pairs), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 18)].astype(np.int64)), pa.array(n[i : i + (1 << 18)])], schema=schema)

    counts = W.store(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.shiftright("pair", _BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # at most 2**16 rows
    out = W.store(counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-bests")
    W.drop(counts)
    return out


def _least_of_head(counts: DataFrame, most: int) -> int:
    """The least count, a power of two, such that no more than ``most`` pairs have it."""
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(F.length(F.bin("n")).alias("power")).agg(F.count("*").alias("pairs")).collect()}
    taken = 0
    for power in range(63, 0, -1):
        taken += sizes.get(power, 0)
        if taken > most:
            return 1 << power
    return 1


def evidence(aligned: DataFrame, counts: DataFrame, most: int | None = None) -> DataFrame:
    """The stored alignments' rows with n_best and count_sum, over links."""
    least = _least_of_head(counts, HEAD if most is None else most)
    head = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    shipped = aligned.sparkSession.sparkContext.broadcast(
        (head["pair"].to_numpy().astype("<u4"), head["n"].to_numpy().astype(np.int64), head["best"].to_numpy().astype(np.int64))
    )
    named = aligned.drop("groups", "pairs", "times").columns

    def lookup(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = shipped.value[0]
        if not len(keys):
            return np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool)
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return at, keys[at] == pairs

    def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, (p, t) in enumerate(zip(batch.column("pairs"), batch.column("times"))):
            yield i, np.frombuffer(p.as_py(), dtype="<u4"), np.frombuffer(t.as_py(), dtype="<u4").astype(np.int64)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = shipped.value
        for batch in batches:
            n_best, total = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for i, pairs, times in pairs_of(batch):
                at, hit = lookup(pairs)
                n_best[i], total[i] = best[at[hit]] @ times[hit], n[at[hit]] @ times[hit]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in named), pa.array(n_best), pa.array(total)], names=[*named, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for i, pairs, times in pairs_of(batch):
                left = ~lookup(pairs)[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(left.sum()), rows[i], dtype=np.int64)), pa.array(pairs[left].astype(np.int64)), pa.array(times[left])], names=["of", "pair", "times"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in named)
    out = aligned.drop("groups").mapInArrow(known, f"{kinds}, n_best long, count_sum long")
    if least == 1:  # every pair was shipped
        return out
    rare = aligned.select("row", "pairs", "times").mapInArrow(others, "of long, pair long, times long").join(counts.where(F.col("n") < least), "pair")
    more = rare.groupBy("of").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    zero = F.lit(0).cast("long")
    return out.join(more, F.col("row") == F.col("of"), "left").select(*named, (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"))


def alignment_digest(documents: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Counts, evidence and the groups' SHA-256 of every row."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = W.store(align(documents, a, b).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return evidence(aligned, pair_counts(aligned)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
