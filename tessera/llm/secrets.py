"""Secret scans: fixed patterns, and character Markov models by log-likelihood ratio.

Built-in functions only. The patterns give the base spans. On top of them, runs
of key characters are scored by two first-order character models, one of random
strings, one of ordinary identifiers, trained from labelled samples; a run whose
log-likelihood ratio is high enough, per character step and in total, is a
further span of kind ``model``. The least ratio per step is fitted on held-out
samples. Both models fold into one constant array of 128 x 128 log ratios
inside the expression, so the scan is one map-side projection over whole texts.
Positions come from running sums by doubling and scores from one pass over a
run's characters, so a long text or a long run costs hardly more than its length.

Defined results: a null or empty text has no spans; positions are in code
points, ends exclusive; matches of one kind never overlap and failing ones are
dropped whole; a ``model`` span that meets a base span is left to the base.
Rows are judged one by one, so repeated rows and ids stay. The spans are one
added column, whose name must be free; other columns pass through. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The contract's patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"

#: Runs that the models score.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
#: Log-likelihood ratio that a run needs in total: random strings may be rare, one in e**24 runs, and still be found.
LEAST_TOTAL = 24.0
#: Labelled strings of each class; half train the models, half fit the ratio per step.
SAMPLES = 4096
#: Weight of a character's own share where a pair of them was hardly seen.
BACKOFF = 16
#: Of held-out samples, the share at either end that the fitted ratio leaves aside.
TAIL = 0.01

# Stems of ordinary identifiers for the labelled sample.
STEMS = (
    "account", "action", "address", "array", "batch", "block", "buffer", "button", "cache", "channel", "class", "client",
    "column", "config", "content", "count", "create", "current", "data", "date", "default", "delete", "device", "document",
    "element", "error", "event", "example", "field", "file", "filter", "folder", "format", "frame", "group", "handler",
    "header", "height", "image", "index", "input", "item", "label", "language", "layer", "length", "level", "library",
    "license", "list", "local", "manager", "message", "method", "model", "module", "month", "name", "network", "node",
    "number", "object", "option", "order", "output", "package", "page", "parent", "parse", "partition", "path", "pattern",
    "people", "picture", "point", "position", "process", "product", "project", "property", "query", "record", "region", "report",
    "request", "result", "return", "schema", "screen", "section", "server", "service", "session", "source", "state", "status",
    "stream", "string", "style", "system", "table", "target", "template", "thread", "time", "title", "type", "update",
    "user", "value", "version", "view", "weight", "width", "window", "worker",
)


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, random): keys in four spellings, and identifiers joined from stems, with years and counters."""
    ids = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hex"))
    raw = F.unhex("hex")
    plain = F.regexp_replace(F.base64(raw), "[+/=]", "")
    key = F.element_at(F.array(F.base64(raw), plain, F.translate(F.base64(raw), "+/", "-_"), F.substring("hex", 1, 40)), (F.col("id") % 4 + 1).cast("int"))
    stems = F.split(F.lit(",".join(STEMS)), ",")
    pick = lambda salt: F.get(stems, F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(STEMS))).cast("int"))
    a, b, c = pick(1), pick(2), pick(3)
    number = (F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(130)) + 1900).cast("string")
    small = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(20)).cast("string")
    name = F.element_at(
        F.array(F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b, number), F.concat_ws("/", a, b, F.concat(c, small)), F.upper(F.concat_ws("_", a, b, c, small)), F.concat(a, b, c, number)),
        (F.col("id") % 6 + 1).cast("int"),
    )
    return ids.select(key.alias("text"), F.lit(True).alias("random")).unionAll(ids.select(name.alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> Column:
    """The constant array of log ratios, by 128 * code of a character + code of the next."""
    steps = samples.where(F.length("text") > 1).select("random", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i"))
    pairs = steps.select("random", F.ascii(F.substring("text", F.col("i"), F.lit(1))).alias("a"), F.ascii(F.substring("text", F.col("i") + 1, F.lit(1))).alias("b")).where("a < 128 and b < 128")
    seen: dict[tuple[bool, int], dict[int, int]] = {}
    for r in pairs.groupBy("random", "a", "b").count().collect():  # at most 2 * 128 * 128 rows
        seen.setdefault((r["random"], r["a"]), {})[r["b"]] = r["count"]

    alone: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for (random, _), row in seen.items():
        for b, n in row.items():
            alone[random][b] = alone[random].get(b, 0) + n

    def log_p(random: bool, a: int, b: int) -> float:
        # Pairs that were not seen fall back on how common the second character is.
        row, single = seen.get((random, a), {}), alone[random]
        share = (single.get(b, 0) + 0.5) / (sum(single.values()) + 0.5 * 64)
        return math.log((row.get(b, 0) + BACKOFF * share) / (sum(row.values()) + BACKOFF))

    cells = [log_p(True, a, b) - log_p(False, a, b) for a in range(128) for b in range(128)]
    return F.split(F.lit(",".join(f"{x:.4f}" for x in cells)), ",").cast("array<double>")


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def scanned(values: Column, op, neutral: int) -> Column:
    """Running ``op`` over an array of integers, in about log2(n) passes over it."""

    def run(v: Column) -> Column:
        n = F.size(v)

        def step(acc: Column, k: Column) -> Column:
            by = F.least(F.pow(F.lit(2.0), k).cast("int"), n)
            return F.zip_with(acc, F.concat(F.array_repeat(F.lit(neutral), by), F.slice(acc, 1, n - by)), op)

        return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int")), v, step)).otherwise(v)

    return let(values, run)


def ratio(token: Column, model: Column) -> Column:
    """Total log-likelihood ratio of a token of two characters or more."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    steps = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(model, a * 128 + b))
    return let(codes, lambda c: F.aggregate(steps(c), F.lit(0.0), lambda sum_, x: sum_ + x))


def fit(samples: DataFrame) -> tuple[Column, float]:
    """The models' constant, and the least ratio per step: between held-out identifiers and random strings, three times as near to these."""
    held = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2)) == 1
    model = train(samples.where(~held))
    scored = samples.where(held & (F.length("text") > 1)).select("random", (ratio(F.col("text"), model) / (F.length("text") - 1)).alias("r"))
    ends = scored.agg(F.percentile(F.when(~F.col("random"), F.col("r")), 1 - TAIL).alias("low"), F.percentile(F.when(F.col("random"), F.col("r")), TAIL).alias("high")).first()
    return model, 0.25 * ends["low"] + 0.75 * ends["high"]


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


_SPANS = "array<struct<start:int,end:int,text:string>>"


def _found(text: Column, pattern: str) -> Column:
    """Start, end and text of each match: what lies between matches gives the positions."""

    def place(hits: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        ends = scanned(F.zip_with(pieces, hits, lambda p, h: F.length(p) + F.length(h)), lambda a, b: a + b, 0)
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("text"))).cast(_SPANS)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, place(hits)).otherwise(F.array().cast(_SPANS)))


def _clear(tokens: Column, base: Column) -> Column:
    """The tokens that meet no base span: sorted together, none before ends later and none behind starts sooner."""
    far = 2**31 - 1
    tagged = lambda spans, kind: F.transform(spans, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(kind).alias("kind"), h["text"].alias("text")))

    def apart(both: Column) -> Column:
        before = scanned(F.transform(both, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)), _most, 0)
        behind = F.reverse(scanned(F.reverse(F.transform(both, lambda x: F.when(x["kind"] == 0, x["start"]).otherwise(far))), _least, far))
        rows = F.zip_with(F.zip_with(both, before, lambda x, b: F.struct(x.alias("x"), b.alias("before"))), behind, lambda y, b: F.struct(y["x"].alias("x"), y["before"].alias("before"), b.alias("behind")))
        kept = F.filter(rows, lambda r: (r["x"]["kind"] == 1) & (r["before"] <= r["x"]["start"]) & (r["behind"] >= r["x"]["end"]))
        return F.transform(kept, lambda r: F.struct(r["x"]["start"].alias("start"), r["x"]["end"].alias("end"), r["x"]["text"].alias("text"))).cast(_SPANS)

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), let(F.sort_array(F.concat(tagged(base, 0), tagged(tokens, 1))), apart)).otherwise(tokens)


def scan(documents: DataFrame, model: Column | None = None, threshold: float | None = None, into: str = "secrets") -> DataFrame:
    """The documents with ``into``: a struct of ``assign``, ``access``, ``hex`` and ``model``, each an array of (start, end, text)."""
    if into.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"the documents have a column {into!r} already")
    if model is None:
        model, fitted = fit(labelled_samples(documents.sparkSession))
        threshold = fitted if threshold is None else threshold
    if threshold is None:
        raise ValueError("a model of one's own needs a threshold")

    def random(h: Column) -> Column:
        return let(ratio(h["text"], model), lambda r: (r > LEAST_TOTAL) & (r > threshold * (F.length(h["text"]) - 1)))

    def kinds(text: Column) -> Column:
        assign = F.filter(_found(text, ASSIGN), lambda h: F.length(F.regexp_extract(h["text"], ASSIGN, 2)) >= ASSIGN_LEAST)
        return F.struct(assign.alias("assign"), _found(text, ACCESS).alias("access"), _found(text, HEX).alias("hex"), _found(text, TOKEN).alias("model"))

    def settle(k: Column) -> Column:
        base = F.concat(k["assign"], k["access"], k["hex"])
        return F.struct(k["assign"].alias("assign"), k["access"].alias("access"), k["hex"].alias("hex"), F.filter(_clear(k["model"], base), random).alias("model"))

    return documents.withColumn(into, let(let(F.coalesce("text", F.lit("")), kinds), settle))


def _span(kind: int, name: str, hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(kind).alias("order"), h["end"].alias("end"), F.lit(name).alias("kind")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, into: str = "secrets") -> DataFrame:
    """The scan's counts and span lists per document."""
    of = lambda c: F.col(f"{into}.{c}")
    base = F.concat(_span(0, "assign", of("assign")), _span(1, "access", of("access")), _span(2, "hex", of("hex")))
    every = F.concat(base, _span(3, "model", of("model")))
    size = lambda c: F.size(of(c)).cast("long").alias(f"n_{c}")
    return scanned.select("doc_id", size("assign"), size("access"), size("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redact(found: DataFrame, mark: str = "[SECRET]", into: str = "secrets") -> DataFrame:
    """``text`` with each span replaced by ``mark``; spans that overlap are one. Null texts stay null; ``into`` goes."""
    of = lambda c: F.col(f"{into}.{c}")
    spans = F.sort_array(F.transform(F.concat(of("assign"), of("access"), of("hex"), of("model")), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))

    def cut(x: Column) -> Column:
        # ``to`` is how far the spans before reach; one that starts behind it opens a new mark.
        to = F.concat(F.array(F.lit(0)), scanned(F.transform(x["spans"], lambda s: s["end"]), _most, 0))
        marks = lambda t: F.filter(F.zip_with(F.slice(t, 1, F.size(x["spans"])), x["spans"], lambda a, s: F.struct(a.alias("from"), s["start"].alias("to"))), lambda m: m["to"] >= m["from"])
        text = lambda a, n: F.array_join(F.slice(x["chars"], a + 1, n), "")
        return let(to, lambda t: F.concat(F.array_join(F.transform(marks(t), lambda m: F.concat(text(m["from"], m["to"] - m["from"]), F.lit(mark))), ""), text(F.element_at(t, -1), F.size(x["chars"]))))

    done = let(F.struct(spans.alias("spans"), F.split("text", "").alias("chars")), cut)
    return found.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text"))).drop(into)
