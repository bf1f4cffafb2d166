"""Quality rules: a learned decision list on top of fixed base rules.

One pass over whole texts gives each document's counts; ratios of them are the
features. From labelled documents, sequential covering learns what low quality
looks like: each rule is grown as a conjunction of thresholds by information
gain on one part of the rows, pruned on the other, and kept while it stays
precise there; the rows it covers are set aside and the next rule is grown. The
list becomes one ordered conditional expression.

Defined results: a null or blank text has no words and fails the base rules; a
null ``doc_id`` stays null; rows are judged one by one, so repeated rows stay.
Labels that are null, or whose document is missing, are ignored; with no usable
labels the list is empty and only the base rules decide. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _hashing as H
from tessera.llm import _work as W

#: Labelled rows that the list is learned from, at most; the least by a hash of their id.
MAX_LABELLED = 6000
REPEAT_WINDOW = 8
_SYMBOLS, _SPACES, _UPPER, _LOWER = b"#*$%&|<>", b" \t\n\v\f\r", bytes(range(65, 91)), bytes(range(97, 123))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_upper", "n_letters", "n_marks")
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "upper_share": ("n_upper", "n_letters"),
    "stutter_share": ("n_stutter", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "mean_word": ("word_chars", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def counts_of(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    dropped = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    h = H.word_hashes(words)
    grams = H.windows(h, REPEAT_WINDOW)
    repeat = 0
    if len(grams):
        kinds, back, n = np.unique(grams, return_inverse=True, return_counts=True)
        if len(kinds) < len(grams):
            repeat = int(H.cover(len(words), np.flatnonzero(n[back] > 1), REPEAT_WINDOW).sum())
    upper = dropped(_UPPER)
    return (len(words), len(text) - dropped(_SPACES), dropped(_SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines), int((h[1:] == h[:-1]).sum()), upper, upper + dropped(_LOWER), dropped(b"!?"))


_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.array([counts_of(t.as_py()) for t in b.column("text")], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(table[:, j]) for j in range(len(COUNTS)))], schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """One threshold of a conjunction."""

    feature: str
    above: bool
    at: float

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.at if self.above else x[self.feature] <= self.at

    def column(self) -> Column:
        return feature(self.feature) > self.at if self.above else feature(self.feature) <= self.at

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for test in rule:
        out &= test.rows(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Add the threshold of most information gain until no good row is covered."""
    rule: list[Test] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        before = math.log2(p0 / (p0 + n0))
        best: tuple[float, Test] | None = None
        for name, v in x.items():
            order = np.argsort(v[inside], kind="stable")
            sorted_v, hits = v[inside][order], np.cumsum(bad[inside][order])
            ends = np.flatnonzero(sorted_v[1:] > sorted_v[:-1])
            if not len(ends):
                continue
            low_p = hits[ends]
            low_n = ends + 1 - low_p
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-9):
                    best = (float(gain[i]), Test(name, above, float((sorted_v[ends[i]] + sorted_v[ends[i] + 1]) / 2)))
        if best is None:
            break
        rule.append(best[1])
        inside &= best[1].rows(x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    """Precision with one good row more, and bad rows covered."""
    hit = _covers(rule, x, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p / (p + n + 1), p)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, ids: np.ndarray, precision: float = 0.95, most_tests: int = 4, most_rules: int = 12) -> list[Rule]:
    """Rules for bad rows, in order. Every third row by ``ids`` is held back for pruning."""
    rules: list[Rule] = []
    prune = H.mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(3) == 0
    left = np.ones(len(bad), dtype=bool)
    pick = lambda mask: ({k: v[mask] for k, v in x.items()}, bad[mask])
    while len(rules) < most_rules:
        grow_x, grow_y = pick(left & ~prune)
        held_x, held_y = pick(left & prune)
        if not grow_y.any() or not held_y.any():
            break
        rule = _grow(grow_x, grow_y, most_tests)
        cuts = [rule[:i] for i in range(1, len(rule) + 1)]
        if not cuts:
            break
        rule = max(cuts, key=lambda r: (_worth(r, held_x, held_y)[0], -len(r)))
        every = _covers(rule, x, len(bad)) & left
        hit, held_hit = int((every & bad).sum()), _worth(rule, held_x, held_y)[1]
        if not held_hit or hit < precision * every.sum():
            break
        rules.append(rule)
        left &= ~every
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: the number of the first rule that fits, else null."""
    out: Column | None = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from at most ``most`` labelled documents, those of them that pass the base rules."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_doc")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("label_doc"), "label_doc").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen.select("label_doc")), F.col("doc_id") == F.col("label_doc"), "left_semi")
    known = measure(rows).where(~base_failed()).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_doc")).select("doc_id", "quality", *(feature(f).alias(f) for f in FEATURES)).toPandas()  # at most ``most`` ids
    known = known.sort_values(["doc_id", *FEATURES]).reset_index(drop=True)
    if known.empty:
        return []
    return learn({f: known[f].to_numpy(float) for f in FEATURES}, known["quality"].to_numpy() == 0, known["doc_id"].to_numpy())


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, base verdict, the first fitting rule and the final verdict of every document."""
    return measure(documents).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that pass, with all their columns."""
    schema, counts = documents.schema, W.free_name(documents, "counts")
    count_types = ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [dict(zip(COUNTS, counts_of(t.as_py()))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.struct([(c, pa.int64()) for c in COUNTS])), *b.columns], names=[counts, *b.schema.names])

    measured = documents.mapInArrow(run, f"{counts} struct<{count_types}>, {_ddl(schema)}")
    flat = measured.select(F.struct(*(F.col(f"`{c}`") for c in schema.names)).alias("_row"), f"{counts}.*")
    good = flat.where(~base_failed() & verdict(rules).isNull())
    return good.select("_row.*")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
