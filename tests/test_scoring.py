"""Hand-derived scoring, geometry and sampler cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import scoring as S
from tessera.operators import conversation as C
from tessera.operators import generate as N
from tessera.operators import policy as P
from tessera.sources import readers as R


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "content, golds, method, want",
    [
        ("\\boxed{B}", ["\\boxed{B}"], "default", 1.0),
        ("\\boxed{B} \\boxed{B}", ["\\boxed{B}"], "default", 0.0),
        ("B.", ["\\boxed{B}"], "default", 0.0),
        ("\\boxed{7}", ["\\boxed{7.0}"], "default", 1.0),
        ("<answer>yes</answer>", ["no"], "yes_no", 0.0),
        ("maybe", ["perhaps"], "yes_no", 1.0),
        ("<answer>C.</answer>", ["A", "C"], "mcq", 1.0),
        ("\\boxed{abc}", ["\\boxed{abd}"], "string_matching", 2 / 3),
        ("\\boxed{\\frac12}", ["1/2"], "math", 1.0),
    ],
)
def test_accuracy(spark, content, golds, method, want):
    score = S.accuracy(F.lit(content), F.array(*map(F.lit, golds)), F.lit(method), match_type="levenshtein_similarity")
    assert one(spark, score) == pytest.approx(want)


@pytest.mark.parametrize("text, want", [("The answer is B. Not A.", "B"), ("x", "X"), ("no choices here", None), ("", None), ("A. B. C.", "C")])
def test_extract_choice(spark, text, want):
    assert one(spark, S.extract_choice(F.lit(text))) == want


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("a", "", 0.0), ("abc", "abd", 2 / 3), ("kitten", "sitting", 8 / 13)])
def test_indel(spark, a, b, want):
    assert one(spark, S.indel_ratio(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_overlap_edges(spark):
    b = lambda *v: G.box(*map(F.lit, v))
    assert tuple(one(spark, G.overlap(b(0, 0, 10, 10), b(0, 0, 10, 10)))) == (1.0, 1.0, 1.0)
    assert tuple(one(spark, G.overlap(b(0, 0, 10, 10), b(10, 0, 20, 10)))) == (0.0, 0.0, 0.0)
    assert tuple(one(spark, G.overlap(b(5, 5, 5, 5), b(0, 0, 10, 10)))) == (0.0, 0.0, 0.0)


def test_declared_box_type_is_checked(spark):
    pad = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    with pytest.raises(Exception, match="not < 1"):
        one(spark, G.normalized(G.box(F.lit(1), F.lit(0), F.lit(2), F.lit(2)), pad, F.lit(10), F.lit(10), "relative"))


def test_sampler_golden_case(spark):
    rows = P.repeat_sampler(spark.range(7), "id", batch=3, repeat=4, mini_repeat=2)
    assert rows.count() == 48 and rows.select("id").distinct().count() == 6


def test_ring_keeps_the_last(spark):
    held = {r["slot"]: r["id"] for r in P.ring_buffer(spark.range(7), "id", 3).collect()}
    assert held == {0: 6, 1: 4, 2: 5}


def test_seed_matches_python(spark):
    import hashlib

    want = 42 + int(hashlib.sha256(b"1024_4_8").hexdigest(), 16) % 1_000_000
    assert one(spark, N.seed_of(42, F.lit("1024_4_8"))) == want


def test_negative_boxes_are_near_the_target(spark):
    from tessera.plans.dataset_queries import _refs

    out = N.negative_boxes(_refs(spark, "/root/testdata/sf0.001"), "k", "ref", "w", "h", 0.3, tries=64).collect()
    assert out and sum(r["error"] is not None and r["error"] <= 0.05 for r in out) >= 0.95 * len(out)


def test_tool_call_spellings(spark):
    for spelling in ('"bbox_2d" :[1, 2, 3, 4]', '"bbox_2d": [1, 2, 3, 4]', '"bbox_2d":[1, 2, 3, 4] '):
        text = f'<tool_call>{{"name": "zoom_in", "arguments": {{"target_image":1, {spelling}}}}}</tool_call>'
        call = one(spark, C.extract_tool(F.lit(text), strict=True))
        assert call["arguments"]["bbox_2d"] == [1, 2, 3, 4] and call["arguments"]["target_image"] == 1
    assert one(spark, C.extract_tool(F.lit("<tool_call>no json</tool_call>"))) is None


def test_canonical_files(spark, tmp_path):
    path = str(tmp_path / "c.jsonl")
    rows = spark.createDataFrame([("q", ["a.png"], ["x"])], "problem string, image array<string>, solution array<string>")
    R.write_json_lines(rows, path)
    R.write_json_lines(rows, path, append=True)
    got = R.canonical(spark, ["d"], [path], ["imgs"]).collect()
    assert [(r["image_path"], r["solution"], r["accu_reward_method"]) for r in got] == [(["imgs/a.png"], ["x"], "default")] * 2
    bad = str(tmp_path / "bad.jsonl")
    spark.createDataFrame([('{"problem": "q"}',)], "value string").write.text(bad)
    with pytest.raises(Exception, match="missing required keys"):
        R.canonical(spark, ["d"], [bad], ["imgs"]).collect()
    with pytest.raises(R.UnknownFormat):
        R.scan(spark, "x.csv")
    with pytest.raises(FileNotFoundError):
        R.scan(spark, str(tmp_path / "none.parquet"))


def test_result_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"accuracy": [1.0, 0.0], "tool_use": [0, 2]}')
    (tmp_path / "broken.json").write_text('{"accuracy": [1.0')
    assert [tuple(r) for r in R.results(spark, str(tmp_path / "r.json")).orderBy("sample_id").collect()] == [(0, 1.0, 0), (1, 0.0, 2)]
    assert R.results(spark, str(tmp_path / "none.json")) is None
    assert R.results(spark, str(tmp_path / "broken.json")) is None
