"""Answer scoring over boxed and tagged texts derived from ``documents``, ``benchmark``, ``part`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import scoring as S
from tessera.operators import metrics as M
from tessera.plans.registry import Registry, table

registry = Registry()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per source, overall and by tool use, of boxed language answers."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("eval"),
        F.concat(F.lit("reasoning \\boxed{"), F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")), F.lit("}")).alias("content"),
        F.array(F.concat(F.lit("\\boxed{"), "lang", F.lit("}"))).alias("golds"),
        (F.col("doc_id") % 4).alias("tool_use"),
    )
    checked = rows.withColumn("verified", S.symbolic_verdicts(F.col("content"), F.col("golds")))
    scored = checked.withColumn("accuracy", S.accuracy(F.col("content"), F.col("golds"), F.lit("default"), verified=F.col("verified")))
    return scored.groupBy("eval").agg(F.round(M.accuracy(), 6).alias("accuracy"), F.round(M.accuracy_if(True), 6).alias("accuracy_if_tool_used"), F.round(M.accuracy_if(False), 6).alias("accuracy_if_tool_not_used"))


# Two-letter languages: the similarity of different ones is the share of common letters in order.
_SIMILAR = "CASE WHEN a = b THEN 1.0::DOUBLE WHEN a[1] = b[1] OR a[2] = b[2] OR a[1] = b[2] OR a[2] = b[1] THEN 0.5 ELSE 0.0 END"


@registry.query(f"""
WITH d AS (SELECT source AS eval, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS a, lang AS b, doc_id % 4 AS uses FROM documents), s AS (SELECT eval, uses, {_SIMILAR} AS acc FROM d)
SELECT eval, round(avg(acc) * 100, 6) AS accuracy, round(avg(CASE WHEN uses > 0 THEN acc END), 6) AS accuracy_if_tool_used, round(avg(CASE WHEN uses = 0 THEN acc END), 6) AS accuracy_if_tool_not_used FROM s GROUP BY eval""")
def r_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


_BOXED = "t AS (SELECT doc_id, repeat('\\boxed{' || lang || '}', CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 5 = 1 THEN 0 ELSE 1 END) AS content, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'en' END AS gold, lang, doc_id % 5 AS k FROM documents)"


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("doc_id") % 5 == 0, 2).when(F.col("doc_id") % 5 == 1, 0).otherwise(1)
    content = F.array_join(F.array_repeat(F.concat(F.lit("\\boxed{"), "lang", F.lit("}")), n), "")
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("en").alias("gold"))


@registry.query(f"WITH {_BOXED}, p AS (SELECT doc_id, k, lang AS a, gold AS b FROM t) SELECT doc_id, CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE {_SIMILAR} END AS score FROM p")
def r_default_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir).select("doc_id", S.default_accuracy(F.col("content"), F.concat(F.lit("\\boxed{"), "gold", F.lit("}"))).alias("score"))


@registry.query(f"WITH {_BOXED}, p AS (SELECT doc_id, k, lang AS a, gold AS b FROM t) SELECT doc_id, CASE WHEN k >= 2 AND a = b THEN 1.0::DOUBLE ELSE 0.0 END AS exact, CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE {_SIMILAR} END AS similar FROM p")
def r_string_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.concat(F.lit("\\boxed{"), F.upper("gold"), F.lit("}"))
    return _boxed(spark, sf_dir).select("doc_id", S.string_match(F.col("content"), gold, "exact_match", "lowercase").alias("exact"), S.string_match(F.col("content"), gold, "levenshtein_similarity", "lowercase").alias("similar"))


@registry.query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN chr((65 + o_custkey % 26)::INT) WHEN 2 THEN chr((65 + o_custkey % 4)::INT) WHEN 3 THEN chr((66 + o_custkey % 4)::INT) ELSE chr((65 + o_custkey % 7)::INT) END AS choice FROM orders""")
def f_extract_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda base, n: F.chr(F.lit(base) + F.col("o_custkey") % n)
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, "no choice in here at all")
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("picking "), F.lower(letter(65, 26)), F.lit(".")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("Z; 11 22 33 44 55 66 77 88 99 00 正确 答案: "), letter(65, 4), F.lit(".")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("Z, Y; 11 22 33 44 55 66 77 88 99 00: "), letter(66, 4), F.lit(".")))
        .otherwise(F.concat(F.lit("答案 "), letter(65, 7), F.lit(", 11 22 33 44 55 66 77 88 99 00 Z")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", S.extract_choice(text).alias("choice"))


@registry.query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = o_orderkey % 4 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM orders")
def r_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("<think>A or B</think><answer> "), F.chr(65 + F.col("o_custkey") % 3), F.lit(".\n</answer>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.mcq(content, F.chr(65 + F.col("o_orderkey") % 4)).alias("score"))


@registry.query("""
WITH w AS (SELECT doc_id, regexp_extract(lower(text), '(yes|no)', 1) AS a, CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS b FROM documents) SELECT doc_id, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM w""")
def r_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.element_at(F.array(F.lit("<answer>Yes</answer>"), F.lit("No."), F.lit("perhaps")), (F.col("doc_id") % 3 + 1).cast("int"))
    content = F.concat(F.lit("<answer>"), "text", F.lit("</answer>"))
    return table(spark, sf_dir, "documents").select("doc_id", S.yes_no(content, gold).alias("score"))


@registry.query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE WHEN o_custkey = o_custkey % 50 THEN 1.0 ELSE 0.0 END AS score FROM orders")
def r_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_orderkey") % 7 == 0, F.concat("o_custkey", F.lit("d"))).otherwise(F.concat(F.lit(" "), "o_custkey", F.lit(".0\n")))
    b = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise((F.col("o_custkey") % 50).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.numeric(a, b).alias("score"))


@registry.query(r"""
WITH c AS (SELECT doc_id, text AS t FROM documents), r AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([ \t\r\f\v\x{A0}])\n', '\1', 'g'), '\n\n+', E'\n', 'g') AS t FROM c)
SELECT doc_id, lower(regexp_replace(regexp_replace(replace(t, E'\n', ' '), '^\s+|\s+$', '', 'g'), '\.+$', '')) AS clean FROM r""")
def f_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<answer>first</answer> <answer>"), "text", F.lit("</answer>"))
    return table(spark, sf_dir, "documents").select("doc_id", S.clean_text(text).alias("clean"))


@registry.query("""
WITH RECURSIVE p AS (SELECT p_partkey, p_name AS a, p_brand || p_name AS b FROM part),
l AS (SELECT p_partkey, a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS r FROM p
  UNION ALL SELECT p_partkey, a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, greatest(r[j + 1], acc[j], r[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN 1 ELSE 0 END)), [0]) FROM l WHERE i < length(a))
SELECT p_partkey, round(2.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b)), 6) AS ratio FROM l WHERE i = length(a)""")
def f_indel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS a", "p_brand || p_name AS b")
    return p.select("p_partkey", F.round(S.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@registry.query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 1.0::DOUBLE ELSE 0.0 END AS think, CASE WHEN o_orderkey % 4 IN (0, 2, 3) THEN 1.0::DOUBLE ELSE 0.0 END AS answer FROM orders")
def r_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "<think>a\nb</think>\n<answer>c</answer>").when(k == 1, "<think>a</think>").when(k == 2, "so <answer>c\n</answer>  ").otherwise("<think></think><answer></answer>")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.format_reward(text).alias("think"), S.format_only_answer(text).alias("answer"))


@registry.query("SELECT o_orderkey, CASE WHEN o_custkey % 9 = o_orderkey % 9 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM orders")
def r_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit("thus $\\boxed{\\dfrac{"), F.col("o_custkey") % 9 + 1, F.lit("}{2}}$"))
    gold = F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("/2"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), gold.alias("gold"), S.symbolic_equal(a, gold).alias("verified"))
    return rows.select("o_orderkey", S.math_score(F.col("a"), F.col("gold"), F.col("verified")).alias("score"))


@registry.query("""
SELECT o_orderkey, (CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE o_custkey % 3 <> 0 END) AS verified,
  (CASE WHEN o_orderkey % 8 <> 7 AND o_custkey % 3 <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM orders""")
def r_math_symbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are written otherwise than the gold ones; every third customer's is off by one, and sums in words are not read."""
    k, off = F.col("o_orderkey") % 8, (F.col("o_custkey") % 3 == 0).cast("long")
    a, b = F.col("o_custkey") % 50 + 2, F.col("o_orderkey") % 7 + 2
    say = lambda shape, *parts: F.format_string(shape.replace("%", "%%").replace("#", "%d"), *parts)
    pairs = [
        (say("\\boxed{\\dfrac{#}{#}}", 3 * a + off, 3 * b), say("\\frac{#}{#}", a, b)),
        (say("\\boxed{x^2+#x+#}", 2 * a + off, a * a), say("(x+#)^2", a)),
        (say("$#.5$", a + off), say("\\frac{#}{2}", 2 * a + 1)),
        (say("\\boxed{#\\sqrt{2}}", a + off), say("\\sqrt{#}", 2 * a * a)),
        (say("\\boxed{(#,\\,#)}", a, b + off), say("\\left(\\frac{#}{2}, #\\right)", 2 * a, b)),
        (say("\\boxed{2^{#}\\cdot 2^{n}}", b + off), say("2^{n+#}", b)),
        (say("\\boxed{\\{#, #\\}}", b + off, a + 100), say("\\{#,#\\}", a + 100, b)),
        (say("\\boxed{# and a half}", a), say("\\frac{#}{2}", 2 * a + 1)),
    ]
    pick = lambda side: F.element_at(F.array(*(p[side] for p in pairs)), (k + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pick(0).alias("a"), pick(1).alias("gold"))
    return rows.withColumn("verified", S.symbolic_equal(F.col("a"), F.col("gold"))).select("o_orderkey", "verified", S.math_score(F.col("a"), F.col("gold"), F.col("verified")).alias("score"))


@registry.query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '\\boxed{a{' || o_custkey || '}}' WHEN 1 THEN NULL WHEN 2 THEN '\\fbox{' || o_custkey || '}' ELSE '\\boxed ' || o_custkey END AS box, CASE o_orderkey % 4 WHEN 0 THEN 'a{' || o_custkey || '}' WHEN 3 THEN '' || o_custkey END AS inside FROM orders")
def f_last_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("\\boxed{1} then \\boxed{a{"), c, F.lit("}} end}")))
        .when(k == 1, F.concat(F.lit("\\boxed{open "), c))
        .when(k == 2, F.concat(F.lit("see \\fbox{"), c, F.lit("}")))
        .otherwise(F.concat(F.lit("$\\boxed "), c, F.lit("$ rest")))
    )
    box = S.last_boxed(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", box.alias("box"), S.let(box, S.unboxed).alias("inside"))


@registry.query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '\\frac{' || o_custkey % 9 || '}{' || o_custkey % 7 || '}' WHEN 1 THEN '\\frac{' || (o_custkey % 9 + 1) || '}{' || (o_custkey % 7 + 1) || '}' WHEN 2 THEN '\\sqrt{' || o_custkey % 9 || '}+0.' || o_custkey % 7 ELSE o_custkey % 9 || '5' END AS norm FROM orders")
def f_strip_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a, b = F.col("o_orderkey") % 4, (F.col("o_custkey") % 9), (F.col("o_custkey") % 7)
    s = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    text = F.when(k == 0, s("\\left\\tfrac", a, b, "\\right\n")).when(k == 1, s(a + 1, "/", b + 1)).when(k == 2, s("x = \\sqrt", a, " + .", b, "\\text{ cm}")).otherwise(s("\\!", a, "5^\\circ\\%"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.strip_latex(text).alias("norm"))


@registry.query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 5 = 1 THEN false ELSE o_custkey % 4 = o_orderkey % 4 END AS same FROM orders")
def f_is_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    a = F.when(k > 1, F.concat(F.lit("\\frac"), F.col("o_custkey") % 4 + 1, F.lit("9")))
    b = F.when(k > 0, F.concat((F.col("o_orderkey") % 4 + 1).cast("string"), F.lit("/9")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.is_equiv(a, b).alias("same"))


@registry.query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pick \\boxed{' || o_custkey % 10 || '}' WHEN o_orderkey % 3 = 1 THEN 'pick (' || o_custkey || '0)' ELSE 'pick (A) now' END AS boxed FROM orders")
def f_paren_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("pick ("), F.col("o_custkey") % 10, F.lit(")"))).when(k == 1, F.concat(F.lit("pick ("), "o_custkey", F.lit("0)"))).otherwise("pick (A) now")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.paren_to_box(text).alias("boxed"))


@registry.query("""
WITH b AS (SELECT o_orderkey, unnest(range(o_orderkey % 4)) AS i, (o_custkey % 50)::INT AS x FROM orders), o AS (SELECT o_orderkey, i, greatest(0, 40 - abs(x + i * 5 - 20)) * 40.0::DOUBLE AS inter FROM b), m AS (SELECT o_orderkey, i, inter / (3200 - inter) AS iou FROM o)
SELECT o.o_orderkey, round(coalesce(arg_min(iou, i), 0), 6) AS first_iou, round(coalesce(arg_max(iou, i), 0), 6) AS last_iou, round(coalesce(avg(iou), 0), 6) AS mean_iou FROM orders o LEFT JOIN m USING (o_orderkey) GROUP BY 1""")
def r_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = G.box(F.lit(20), F.lit(0), F.lit(60), F.lit(40))
    x = (F.col("o_custkey") % 50).cast("int")
    steps = F.slice(F.array(*(F.lit(i) for i in range(3))), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))
    boxes = F.transform(steps, lambda i: G.box(x + i * 5, F.lit(0), x + i * 5 + 40, F.lit(40)))
    return table(spark, sf_dir, "orders").select("o_orderkey", *(F.round(S.iou_reward(boxes, gold, h), 6).alias(f"{h}_iou") for h in ("first", "last", "mean")))


@registry.query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM orders")
def r_format_rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('<answer>{"bbox": ['), "o_custkey", F.lit(", 2,3, 4]}</answer>"))).when(F.col("o_orderkey") % 3 == 1, "<answer>{[1,2,3]}</answer>").otherwise("[1,2,3,4]")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.format_rec(text).alias("score"))


@registry.query("""
WITH b AS (SELECT o_orderkey, (o_custkey % 60)::INT AS x FROM orders), i AS (SELECT o_orderkey, CASE WHEN greatest(x, 20) < least(x + 39, 59) THEN (least(x + 39, 59) - greatest(x, 20) + 1) * 40 ELSE 0 END AS i FROM b)
SELECT o_orderkey, CASE WHEN i / (3200.0 - i) > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM i""")
def r_iou_rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("o_custkey") % 60).cast("int")
    text = F.concat(F.lit("<answer>["), x.cast("string"), F.lit(", 0, "), (x + 40).cast("string"), F.lit(", 40]</answer>"))
    gold = G.box(F.lit(20), F.lit(0), F.lit(60), F.lit(40))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.iou_rec(text, gold).alias("score"))


@registry.query("""
WITH s AS (SELECT l_returnflag AS eval, CASE WHEN l_linenumber = 1 + l_partkey % 3 THEN 1.0::DOUBLE ELSE 0.0 END AS s FROM lineitem) SELECT eval, round(avg(s) * 100, 6) AS rescored FROM s GROUP BY eval""")
def m_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda c: F.concat(F.lit("\\boxed{"), c.cast("string"), F.lit("}"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("eval"), S.string_match(box(F.col("l_linenumber")), box(1 + F.col("l_partkey") % 3), "exact_match").alias("s"))
    return rows.groupBy("eval").agg(F.round(F.avg("s") * 100, 6).alias("rescored"))
