"""Vectors of tries against Spark's own expressions and hashlib, and against one job."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import generate as N
from tessera.operators import tries


def test_draws_are_md5():
    for key in ("", ":7", ":1234567890", ":" + "k" * 80):
        texts = np.frombuffer(key.encode() * 3, dtype=np.uint8).reshape(3, len(key))
        got = tries.draws("0a", texts, np.frombuffer(b":10:11:12", dtype=np.uint8).reshape(3, 3))
        assert got.tolist() == [int(hashlib.md5(f"0a{key}:{t}".encode()).hexdigest()[:13], 16) / 16**13 for t in (10, 11, 12)]


def boxes(spark, n):
    rows = spark.range(n).selectExpr("id AS k", "CAST(id * 37 % 300 + 50 AS INT) AS x", "CAST(id % 200 + 40 AS INT) AS y", "IF(id = 5, NULL, 1000) AS w", "800 AS h")
    return rows.select("k", "w", "h", G.box(F.col("x"), F.col("y"), F.col("x") + 200, F.col("y") + 150).alias("ref"))


def test_candidates_are_those_of_the_expressions(spark):
    for target in (0.3, 0.0):
        made = {(r["k"], r["attempt"]): tuple(r["cand"]) for r in N.candidates(boxes(spark, 40), "k", "ref", "w", "h", target, 12).collect() if r["k"] != 5}
        got = {}
        for row in (r for r in boxes(spark, 40).collect() if r["k"] != 5):
            n = 12
            keys, ref = np.frombuffer(f":{row['k']}".encode() * n, dtype=np.uint8).reshape(n, -1), np.array([tuple(row["ref"])] * n)
            one = lambda name, i: tries.draws(f"0{name}", keys[[i]], np.frombuffer(f":{i}".encode(), dtype=np.uint8)[None])[0]  # noqa: B023,E731
            at, cand = tries.propose(lambda name, rows: np.array([one(name, i) for i in rows]), ref, np.full(n, 1000), np.full(n, 800), target, N.MIN_SIDE)  # noqa: B023
            got |= {(row["k"], int(t)): tuple(c) for t, c in zip(at, cand.tolist())}
        assert got == made


def test_negative_boxes_take_one_job(spark):
    """Rounds of jobs, each with all candidates as rows, took most of the time."""
    rows = boxes(spark, 40).withColumn("others", F.array(G.shift(F.col("ref"), F.lit(120), F.lit(0)), F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")))
    plan = N.negative_boxes(rows, "k", "ref", "w", "h", 0.3, others="others")
    assert "Generate" not in plan._jdf.queryExecution().toString() and "Aggregate" not in plan._jdf.queryExecution().toString()
    got = {r["k"]: r["bbox"] for r in plan.collect()}
    assert got.keys() == set(range(40)) and [k for k, b in got.items() if b is None] == [5]
