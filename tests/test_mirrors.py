"""Mirrors in order, content addresses, and what a second call does."""

import hashlib
import os

from tessera.sources import mirrors as X


def test_fallback_and_second_call(spark, tmp_path):
    for name, files in {"a": {"1": b"one"}, "b": {"1": b"other", "2": b"one", "3": b""}}.items():
        os.makedirs(tmp_path / name)
        for f, content in files.items():
            (tmp_path / name / f).write_bytes(content)
    at = lambda k, *mirrors: [f"file://{tmp_path}/{m}/{k}" for m in mirrors]
    rows = [("1", at(1, "a", "b")), ("2", at(2, "a", "b")), ("3", at(3, "a", "b")), ("4", at(4, "a", "b")), ("5", []), ("6", None), (None, at(1, "a")), ("1", at(1, "b"))]
    df = spark.createDataFrame(rows, "k string, urls array<string>")
    out = f"file://{tmp_path}/out"
    one, empty = (hashlib.sha256(x).hexdigest() for x in (b"one", b""))
    got = {r["key"]: (r["name"], r["size"], r["mirror"]) for r in X.fetch(df.limit(7), "k", "urls", out).collect()}
    assert got["1"] == (one, 3, 0) and got["2"] == (one, 3, 1) and got["3"] == (empty, 0, 1) and got["4"] == got["5"] == got["6"] == (None, None, None)
    assert sorted(n for n in os.listdir(tmp_path / "out") if not n.startswith("_")) == sorted((one, empty))
    (tmp_path / "b" / "4").write_bytes(b"late")
    again = {r["key"]: (r["mirror"], (r["error"] or "").split(":")[0]) for r in X.fetch(df, "k", "urls", out).collect()}
    assert again["4"] == (1, "") and again["5"][1].startswith("no place") and not {"1", "2", "3"} & again.keys()
    assert {r["key"] for r in X.fetched(spark, out).collect() if r["key"]} == {"1", "2", "3", "4"}
