"""Operators against plain Python on small cases that the tables do not hold."""

import bisect
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import scoring as S
from tessera.operators import convert, metrics, policy, tools
from tessera.operators import conversation as C
from tessera.operators.pinned import scratch
from tessera.sources import readers as R


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(last[j + 1], row[j], last[j] + (x == y)))
    return row[-1]


def test_indel_ratio_of_short_and_long_texts(spark):
    rng = random.Random(1)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [("", ""), ("a", ""), ("", "b"), ("abc", "abc"), ("é😀x", "x😀é")]
    for n in (1, 5, 61, 62, 63, 124, 125, 300):
        for m in (1, 62, 130, 250):
            letters = rng.choice(("ab", "abcdefgh", "xyzé😀"))
            pairs.append((text(n, letters), text(m, letters)))
    rows = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>")
    got = {r["i"]: r["s"] for r in rows.select("i", S.indel_ratio(F.col("p.a"), F.col("p.b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert abs(got[i] - (2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)) < 1e-12, (a, b)


def test_indel_ratio_of_long_answers_is_quick(spark):
    text = "the quick brown fox " * 250
    rows = spark.createDataFrame([(text, text[::-1])] * 4, "a string, b string")
    assert all(0.1 < r["s"] < 1 for r in rows.select(S.indel_ratio(F.col("a"), F.col("b")).alias("s")).collect())


def test_bbox_chain_of_any_length(spark):
    rows = [(1, k, k - 1, k * 10, k) for k in range(1, 61)] + [(2, 1, 0, 5, 5), (2, 2, 9, 7, 7), (2, 3, 3, 8, 8)]
    calls = spark.createDataFrame(rows, "c int, k int, t int, x int, y int").select("c", "k", "t", G.box(F.col("x"), F.col("y"), F.col("x") + 3, F.col("y") + 4).alias("box"), (F.col("k") * 2).alias("extra"))
    got = {(r["c"], r["k"]): (r["box"]["x1"], r["box"]["y2"], r["extra"]) for r in C.bbox_chain(calls, "c", "k", "t", "box").collect()}
    assert got == {(1, k): (5 * k * (k + 1), k * (k + 1) // 2 + 4, 2 * k) for k in range(1, 61)} | {(2, 1): (5, 9, 2), (2, 2): (7, 11, 4), (2, 3): (8, 12, 6)}


def test_weighted_draws_follow_the_running_sum(spark):
    rng = random.Random(3)
    weights = [rng.choice((0.0, 0.0, 1.0, 2.5, 40.0)) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(weights)), "k int, w double")
    ends, total = [], 0.0
    for w in weights:
        total += w
        ends.append(total)
    want = {}
    for i in range(400):
        u = int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:13], 16) / 16**13
        want[i] = bisect.bisect_right(ends, u * total)
    assert {r["draw"]: r["k"] for r in policy.weighted_draws(rows, "k", "w", 400, seed=5).collect()} == want


def test_python_repr(spark):
    cases = [[], ["a", None], ["it's"], ['say "it\'s"'], ["back\\slash", "new\nline\ttab\r"], ['"']]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v array<string>")
    assert {r["i"]: r["s"] for r in rows.select("i", convert.python_repr(F.col("v")).alias("s")).collect()} == dict(enumerate(map(repr, cases)))


def test_output_policies_and_resume(spark):
    rows, path = spark.range(3), scratch(spark, "test-output")
    assert R.write_output(rows, path)
    with pytest.raises(FileExistsError):
        R.write_output(rows, path)
    assert not R.write_output(rows.where("id < 1"), path, "skip") and spark.read.parquet(path).count() == 3
    assert R.write_output(rows.where("id < 1"), path, "overwrite") and spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        R.write_output(rows, path, "maybe")
    out, made = scratch(spark, "test-resume"), []

    def make(todo):
        made.append(todo.count())
        return todo.withColumn("v", F.col("id") * 2)

    for n in (2, 5, 5):
        R.resume(spark.range(n), out, ["id"], make)
    assert made == [2, 3, 0] and spark.read.parquet(out).count() == 5


def test_plugins_by_name(spark):
    rewards = policy.Rewards()
    rewards.register("one", lambda data, **_: data["id"] + 1)
    with pytest.raises(ValueError):
        rewards.register("one", lambda data, **_: None)
    with pytest.raises(KeyError):
        rewards.columns(spark.range(1), ["two"])
    kit = tools.default_tools()
    assert kit.schema("show_image")["function"]["name"] == "show_image" and kit.schema("zoom_in")["function"]["name"] == "zoom_in"


def test_guards_raise(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "rank int, slot int")
    with pytest.raises(Exception, match="unequally"):
        policy.sync_buffers(rows, "rank", "slot", 0, 2, 2).collect()
    with pytest.raises(ValueError):
        policy.sync_buffers(rows, "rank", "slot", 2, 2, 2)
    with pytest.raises(Exception, match="disagree"):
        rows.agg(metrics.the_only(F.col("slot"), "prompt_type")).collect()


def test_accuracy_uses_the_verifier_where_there_is_one(spark, tmp_path):
    import importlib
    import os
    import sys

    from pyspark import SparkFiles

    stub = tmp_path / "math_verify.py"
    stub.write_text("def parse(x):\n    return x\n\n\ndef verify(a, b):\n    return float('half' in a and '1/2' in b)\n")
    rows = spark.createDataFrame([(1, "so \\boxed{half}", ["7", "1/2"]), (2, "so \\boxed{other}", ["1/2"]), (3, None, ["1/2"]), (4, "x", None)], "i int, c string, g array<string>")
    score = lambda: {r["i"]: r["s"] for r in rows.withColumn("v", S.symbolic_verdicts(F.col("c"), F.col("g"))).select("i", S.accuracy(F.col("c"), F.col("g"), F.lit("math"), verified=F.col("v")).alias("s")).collect()}
    plain = score()
    spark.sparkContext.addPyFile(str(stub))
    importlib.invalidate_caches()
    try:
        checked = score()
    finally:
        os.remove(SparkFiles.get("math_verify.py"))
        sys.modules.pop("math_verify", None)
        importlib.invalidate_caches()
    assert plain[1] == 0 and checked == plain | {1: 1.0}


def test_selection_in_parts_is_the_whole_sort(spark):
    rows = spark.range(0, 3000, 1, 5).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS w", "id * 2 AS n")
    for k in (0, 1, 40, 2500, 2572, 5000):
        got = {r["id"] for r in policy.weighted_sample(rows, "id", "w", k, seed=4).collect()}
        drawn = rows.where("w > 0").withColumn("k", -F.log(F.greatest(policy.draw(4, "id"), F.lit(1e-15))) / F.col("w"))
        assert got == {r["id"] for r in drawn.orderBy("k", "id").limit(k).collect()}
    for capacity in (1, 64, 2999, 3000, 4000):
        got = {r["slot"]: r["id"] for r in policy.ring_buffer(rows, "n", capacity).collect()}
        assert got == {i % capacity: i for i in range(3000)}
    assert policy.ring_buffer(rows.limit(0), "n", 5).count() == 0 and policy.weighted_sample(rows.limit(0), "id", "w", 5).count() == 0
    names = rows.selectExpr("lpad(CAST(id AS STRING), 5, '0') AS n", "id")
    assert {r["id"] for r in policy.ring_buffer(names, "n", 10).collect()} == set(range(2990, 3000))
