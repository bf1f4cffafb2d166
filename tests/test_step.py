"""A training step reads and scores its rows once."""

import statistics

from pyspark.sql import functions as F

from tessera.operators.step import score_step


def test_one_pass(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    kind = "id long, g long, acc double, uses long, tries long, len double"
    rows = spark.range(0, 200, 1, 3).selectExpr("id", "id div 8 AS g", "CAST(id % 3 = 0 AS DOUBLE) AS acc", "id % 4 AS uses", "id % 4 + id % 2 AS tries", "IF(id % 10 = 0, double('NaN'), CAST(id AS DOUBLE)) AS len").mapInArrow(counted, kind)
    got = score_step(rows, "g", {"acc": F.col("acc"), "none": F.lit(0.0)}, {"acc": 1.0, "none": 3.0}, "acc", "uses", "tries", "len", 150, str(tmp_path / "step"))
    assert read.value == 200
    back = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "step")).collect()}
    assert len(back) == 200 and "_uses" not in back[0].asDict()
    for g in range(25):
        r = [float(i % 3 == 0) for i in range(8 * g, 8 * g + 8)]
        for i, x in zip(range(8 * g, 8 * g + 8), r):
            assert abs(back[i]["advantage"] - (x - statistics.mean(r)) / (statistics.stdev(r) + 1e-4)) < 1e-9
    assert abs(got["tool_group_std"] - statistics.pstdev(statistics.mean(i % 4 for i in range(8 * g, 8 * g + 8)) for g in range(25))) < 1e-9
    assert got["rows"] == 200 and got["acc_mean"] == 67 / 200 and got["acc_nonzero_mean"] == 1 and got["none_nonzero_mean"] == -1
    assert abs(got["tool_success_rate"] - statistics.mean((i % 4) / (i % 4 + i % 2) for i in range(200) if i % 4)) < 1e-9 and abs(got["length_mean"] - statistics.mean(i for i in range(200) if i % 10)) < 1e-9
    assert sum(got[f"{a}_{b}"] for a in ("correct", "wrong") for b in ("tool", "no_tool")) == 200


def test_empty_step(spark, tmp_path):
    rows = spark.range(0).selectExpr("id", "id AS g", "0.0D AS acc", "id AS uses", "id AS tries", "0.0D AS len")
    got = score_step(rows, "g", {"acc": F.col("acc")}, {"acc": 1.0}, "acc", "uses", "tries", "len", 5, str(tmp_path / "step"))
    assert got["rows"] == 0 and got["tool_group_std"] is None and got["tool_success_rate"] == -1.0 and got["acc_mean"] is None
