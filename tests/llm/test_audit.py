"""The filter audit against filters applied one by one, in every order."""

import random
from itertools import permutations

import duckdb
import pytest

from tessera.llm import audit

SCHEMA = "doc_id long, text string, lang string"


def fixture():
    draw = random.Random(5)
    texts = [None, "", " \n", "A" * 40, "one two " * 90, "Word " * 30 + "#", "x " * 100, " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i}" for i in range(120)), " ".join(f"w{i}" for i in range(101)) + " |"]
    rows = [(i, draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(7, "x " * 100, "en"), (7, "x " * 100, "de"), (7, "", "en"), (None, "x " * 100, "en"), (None, None, None), (200, "é" * 300_000 + "ABC", "fr")]
    labels = [(i, draw.randint(0, 1), draw.randint(0, 1)) for i in range(0, 150, 2)] + [(4, 1, 1), (9, None, 1), (None, 1, 1)]
    return rows, labels


def by_hand(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs = []
    for doc, text, lang in rows:
        t = text or ""
        words = t.replace("\x0b", " ").encode().split()
        same = [d for d, other, _ in rows if d is not None and (other or "") == t]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc is not None and min(same) < doc,
        }
        docs.append((lang or "", {f for f, bad in fails.items() if bad}, doc in good, doc in toxic))
    out, worth = [], {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                failing = sum(f in d[1] for d in docs if d[0] == part)
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                only = sum(d[1] == {f} for d in docs if d[0] == part)
                out.append([part, order, step, len(left), len(gone), failing - len(gone), only, sum(d[2] for d in gone), sum(d[3] for d in gone)])
                worth[part, f] = worth.get((part, f), 0) + len(gone)
    return sorted((*r, worth[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = fixture()
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_every_order(tables):
    got = sorted(tuple(r) for r in audit.audit(*tables).collect())
    assert got == by_hand(*fixture())


def test_sql_says_the_same(tables):
    con = duckdb.connect()
    for name, df in zip(("documents", "labels"), tables):
        con.register(name, df.toPandas().astype({"doc_id": "Int64"}) if name == "documents" else df.toPandas().astype("Int64"))
    assert sorted(con.sql(audit.ORACLE_SQL).fetchall()) == by_hand(*fixture())


def test_shapley_of_the_polynomial():
    counts = {0b00011: 7, 0b10000: 5, 0b11111: 10, 0: 3}
    p = audit.removal_polynomial(counts)
    gone = audit.corners(p)
    assert gone[0] == 0 and gone[31] == 22 and gone[0b00001] == 17 and gone[0b10000] == 15
    assert [audit.diagonal_integral(p, i) * 120 for i in range(5)] == [660, 660, 240, 240, 840]
    assert sum(audit.diagonal_integral(p, i) for i in range(5)) == gone[31]


def test_empty_and_clashing_columns(spark, tables):
    docs, labels = tables
    assert audit.audit(docs.limit(0), labels).count() == 0
    odd = docs.selectExpr("*", "1 as part", "2 as mask", "3 as d1", "4 as n", "5 as first", "6 as good")
    assert sorted(map(tuple, audit.audit(odd, labels.limit(0)).collect())) == by_hand(fixture()[0], [])
