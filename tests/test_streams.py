"""Streams in many batches: state across restarts, and late rows."""

import datetime

from pyspark.sql import functions as F

from tessera.operators.pinned import scratch
from tessera.plans.streaming_queries import _stored, arrive
from tessera.streaming import ring as R


def test_the_ring_goes_on_from_its_checkpoint(spark):
    rows = [(p, k, p * 100 + i, p * 1000 + k * 100 + i) for p in range(5) for k in (0, 1) for i in range((3, 0, 12, 1, 25)[p] + k)]
    df = spark.createDataFrame(rows, "part int, rank long, n long, value long")
    checkpoint, path = scratch(spark, "ring"), scratch(spark, "touched")
    arrive(df, 5, lambda s: R.ring(s, "rank", "n", "value", 7), "update", _stored(path), checkpoint)
    want, written = {}, {0: 0, 1: 0}
    touched = {}
    for p in range(5):
        for k in (0, 1):
            for *_, v in sorted(r for r in rows if r[0] == p and r[1] == k):
                want[k, written[k] % 7] = v
                touched[p, k, written[k] % 7] = v
                written[k] += 1
    held = R.contents(spark, checkpoint)
    assert {(r["rank"], r["slot"]): r["value"] for r in held.collect()} == want
    got = spark.read.option("basePath", path).parquet(f"{path}/batch=*").collect()
    batches = sorted({r["batch"] for r in got})
    assert len(batches) == 5 and {(batches.index(r["batch"]), r["rank"], r["slot"]): r["value"] for r in got} == touched
    run = {(r["rank"], r["place"]): (r["slot"], r["value"]) for r in R.read_slots(held, "rank", 3, 3).collect()}
    assert run == {(k, i): ((9 + i) % 7, want[k, (9 + i) % 7]) for k in (0, 1) for i in range(3)}


def test_late_rows_are_left_out(spark):
    t = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = [(0, t(1, 5), "a", 1.0), (1, t(2, 30), "a", 3.0), (2, t(1, 50), "a", 100.0), (2, t(2, 1), "a", 5.0), (3, t(2, 59), "a", 7.0), (4, t(4, 0), "a", 1.0), (5, t(2, 58), "a", 900.0)]
    path = scratch(spark, "means")
    df = spark.createDataFrame(rows, "part int, ts timestamp, k string, v double")
    arrive(df, 6, lambda s: R.running_means(s, "ts", "k", "v"), "update", _stored(path), scratch(spark, "stream"))
    out = spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("start").agg(F.max_by(F.struct("mean", "n"), "batch").alias("r"))
    assert {r["start"].hour: tuple(r["r"]) for r in out.collect()} == {1: (1.0, 1), 2: (5.0, 3), 4: (1.0, 1)}
