"""The unit sink under failures, and the dataset registry's edges."""

import os
import subprocess
import sys
import textwrap

import pytest

from tessera.sources import datasets as D
from tessera.sources import units as U

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_failed_task_attempt_leaves_each_row_once(tmp_path):
    """Tasks may fail only where the master allows attempts, so this runs in a session of its own."""
    code = f"""
    import sys; sys.path.insert(0, {ROOT!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession
    from tessera.sources import units as U
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")

    def shaky(batches):
        for b in batches:
            yield b
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() != 1:
            raise RuntimeError("lost behind its last row")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = spark.range(0, 100, 1, 4).selectExpr("id % 3 AS u", "id").mapInArrow(shaky, "u long, id long")
    U.write_units(rows, "file://{tmp_path}/out", "u")
    got = U.read_units(spark, "file://{tmp_path}/out", "u long, id long").collect()
    assert sorted(r.id for r in got) == list(range(100)), len(got)
    print(sorted((r.unit, r.rows) for r in U.done_units(spark, "file://{tmp_path}/out").collect()))
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": ROOT})
    assert run.returncode == 0, run.stderr[-2000:]
    assert "[('0', 34), ('1', 33), ('2', 33)]" in run.stdout
    assert not os.listdir(f"{tmp_path}/out/_attempts")


def test_units_are_complete_or_absent(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    rows = spark.createDataFrame([("a/b", 1, "é"), ("a/b", 2, None), ("c", 3, "x")], "unit string, n long, t string")
    assert U.done_units(spark, path).count() == 0 and U.read_units(spark, path, rows.schema).count() == 0
    os.makedirs(f"{tmp_path}/u/c")
    open(f"{tmp_path}/u/c/part-00000.jsonl", "w").write('{"unit":"c","n":99,"t":"of a lost commit"}\n')
    assert U.read_units(spark, path, rows.schema).count() == 0
    U.write_units(rows, path, "unit")
    assert sorted(map(tuple, U.read_units(spark, path, rows.schema).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert not os.listdir(f"{tmp_path}/u/_attempts")
    with pytest.raises(Exception, match="complete already"):
        U.write_units(rows.union(spark.createDataFrame([("d", 1, "")], rows.schema)), path, "unit")
    U.write_missing(rows.union(spark.createDataFrame([("d", 1, "")], rows.schema)), path, "unit")
    assert {r["unit"]: r["rows"] for r in U.done_units(spark, path).collect()} == {"a/b": 2, "c": 1, "d": 1}
    for bad in (lambda: U.write_units(rows, path, "none"), lambda: U.write_units(rows.selectExpr("CAST(NULL AS STRING) AS unit", "n"), path, "unit")):
        with pytest.raises(Exception):
            bad()
    assert not os.listdir(f"{tmp_path}/u/_attempts") and U.done_units(spark, path).count() == 3


def test_registry_edges(spark, tmp_path):
    root = f"file://{tmp_path}"
    with pytest.raises(ValueError, match="unknown dataset"):
        D.load(spark, "none", root)
    with pytest.raises(FileNotFoundError):
        D.load(spark, "hr_bench_4k", root)
    with pytest.raises(ValueError, match="layout"):
        D.Dataset("csv", "x")
    rows = spark.createDataFrame([("q", ["a", "b"], "im.jpg", "A", 7)], "question string, `multi-choice options` array<string>, image string, answer string, extra long")
    for i in range(2):
        rows.write.parquet(f"{root}/images_{i}.parquet")
    with pytest.raises(ValueError, match="shard"):
        D.load(spark, "mme_lite", root, 0)
    two = D.load(spark, "mme_lite", root, 2)
    assert two.count() == 2 and two.inputFiles() and len(two.inputFiles()) >= 2
    plan = two.select("problem")._jdf.queryExecution().executedPlan().toString()
    assert "image" not in plan.split("ReadSchema")[1] and "extra" not in plan.split("ReadSchema")[1]  # columns reach the files
