"""Plug-ins by name, and the training loop's bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import convert as V
from tessera.operators import conversation as C
from tessera.operators import metrics as M
from tessera.operators import policy as P
from tessera.operators import tools as T
from tessera.plans.conversation_queries import _CALLS, _calls
from tessera.plans.registry import Registry, table

registry = Registry()
query = registry.query


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity > 25)::INT::DOUBLE AS accuracy, round(l_quantity / max(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS relative, 0.0::DOUBLE AS silent FROM lineitem""")
def r_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reward of one row, one over the group, and one that gives nothing."""
    known = P.Rewards()
    known.register("accuracy", lambda data, **_: (data["l_quantity"] > 25).cast("int"))
    known.register("relative", lambda data, group, **_: F.round(data["l_quantity"] / F.max(data["l_quantity"]).over(Window.partitionBy(group)), 6))
    known.register("silent", lambda data, **_: None)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double"))
    made = known.columns(rows, ["accuracy", "relative", "silent"], group="l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c.alias(n) for n, c in made.items()))


@query("""
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name || '.jpg#' || (100 + n_nationkey) || ',200,' || (400 + n_nationkey) || ',500' WHEN 1 THEN n_name || '.jpg' END AS result FROM nation""")
def tool_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = T.default_tools(padding=0.0)
    tool = F.element_at(F.array(F.lit("zoom_in"), F.lit("show_image"), F.lit("other")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    n = F.col("n_nationkey").cast("double")
    arguments = F.struct(F.array(100.0 + n, F.lit(200.0), 400.0 + n, F.lit(500.0)).alias("bbox_2d"))
    return table(spark, sf_dir, "nation").select("n_nationkey", known.call(tool, arguments, F.concat("n_name", F.lit(".jpg")), F.lit(1000), F.lit(1000)).alias("result"))


_OVER = f"""
{_CALLS}, r AS (SELECT v.conv_id, v.turn, coalesce(k IN (0, 1, 4), false) AS ok FROM conversations v LEFT JOIN c ON c.conv_id = v.conv_id AND c.turn = v.turn),
n AS (SELECT *, sum(ok::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM r), b AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS before FROM n)"""


@query(f"WITH {_OVER} SELECT conv_id, turn, ok AND n <= 1 AS successful FROM b WHERE before <= 1")
def trim_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one good call a conversation, parsed from the turns' texts: the second is un-counted, and what follows it dropped."""
    calls = _calls(spark, sf_dir).select("conv_id", "turn", C.names_tool(C.extract_tool(F.col("text"))["name"], ["zoom_in", "crop_image_normalized"]).alias("successful"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").join(calls, ["conv_id", "turn"], "left").fillna(False, "successful")
    return C.trim_over_limit(turns, "conv_id", "turn", 1)


@query("SELECT conv_id, max(turn) % 2 = 0 AS finished FROM conversations GROUP BY conv_id")
def finished_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    replies = turns.join(last.withColumnsRenamed({"conv_id": "c", "turn": "t"}), F.col("conv_id") == F.col("c")).select("conv_id", ((F.col("turn") == F.col("t")) & (F.col("t") % 2 == 0)).alias("done"))
    of = lambda wanted: C.ids_by_finished(replies, "conv_id", "done", wanted).withColumn("finished", F.lit(wanted))
    return of(True).unionByName(of(False))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '[''' || lang || ''', None]' WHEN doc_id % 4 = 1 THEN '[\"it''s ' || source || '\", ''''' || ']' WHEN doc_id % 4 = 2 THEN '[''a\\\\b\\n\"c'']' ELSE '[]' END AS shown FROM documents")
def array_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("doc_id") % 4, lambda *x: F.array(*x).cast("array<string>")
    texts = F.when(k == 0, s("lang", F.lit(None))).when(k == 1, s(F.concat(F.lit("it's "), "source"), F.lit(""))).when(k == 2, s(F.lit('a\\b\n"c'))).otherwise(s())
    return table(spark, sf_dir, "documents").select("doc_id", V.python_repr(texts).alias("shown"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place >= 600 AND place < 900")
def process_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = P.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumn("place", F.col("rn") - 1)
    return P.process_slice(placed, "place", 2, 300).select("o_orderkey")


@query(f"SELECT o_orderkey, list_extract([o_orderpriority, o_orderstatus, 'x'], 1 + floor(('0x' || substr(md5('11:' || o_orderkey), 1, 13))::BIGINT / {float(16**13)} * 3)::INT) AS gold FROM orders")
def pick_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", P.pick_gold(F.array("o_orderpriority", "o_orderstatus", F.lit("x")), 11, "o_orderkey").alias("gold"))


@query("SELECT r_regionkey, 'zoom' AS prompt_type FROM region")
def implicit_prompt_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt type that all tool configurations of a run share."""
    configs = table(spark, sf_dir, "nation").select("n_regionkey", F.lit("zoom").alias("prompt_type"))
    return configs.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(M.the_only(F.col("prompt_type"), "prompt_type").alias("prompt_type"))


@query("""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT o_orderkey, place % 4 * 1000000 + place // 4 AS global_slot FROM p WHERE place // 4 >= 100 AND place // 4 < 300""")
def buffer_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ranks whose buffers hold the orders in turn: what they wrote to slots 100 to 299, at its global place."""
    placed = P.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    rows = placed.select("o_orderkey", ((F.col("rn") - 1) % 4).alias("rank"), F.floor((F.col("rn") - 1) / 4).alias("slot"))
    return P.sync_buffers(rows, "rank", "slot", 100, 300, 1000000).select("o_orderkey", "global_slot")


@query("SELECT event_id, event_id % 40 = 0 OR event_id % 7 = 0 AS generates FROM events")
def refill_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that make new rollouts: every 40th, and those that find the buffer empty."""
    return table(spark, sf_dir, "events").select("event_id", P.generates(F.col("event_id"), 40, F.col("event_id") % 7).alias("generates"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, (l_quantity > 25)::INT::DOUBLE AS acc, l_tax AS style, l_linenumber % 3 AS uses, l_linenumber % 3 + l_partkey % 2 AS tries, l_extendedprice AS len FROM lineitem),
w AS (SELECT *, 2.0::DOUBLE * acc + 0.5::DOUBLE * style AS reward FROM r),
a AS (SELECT *, (reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-4) AS adv FROM w WINDOW g AS (PARTITION BY l_orderkey)),
g AS (SELECT avg(uses) AS m FROM r GROUP BY l_orderkey)
SELECT count(*) AS rows, round(avg(acc), 6) AS acc_mean, round(coalesce(avg(nullif(style, 0)), -1), 6) AS style_nonzero_mean,
  count(*) FILTER (acc > 0.5 AND uses > 0) AS correct_tool, count(*) FILTER (acc <= 0.5 AND uses = 0) AS wrong_no_tool,
  (SELECT round(stddev_pop(m), 6) FROM g) AS tool_group_std, round(coalesce(avg(CASE WHEN tries <> 0 THEN uses / tries::DOUBLE END), -1), 6) AS tool_success_rate,
  count(*) FILTER (len >= 50000) AS truncated, round(max(adv), 5) AS advantage_max, round(avg(len), 4) AS length_mean, count(*) FILTER (adv > 0.001) AS written_above
FROM a""")
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics that the job observed which wrote rewards and advantages, beside a count over what it wrote."""
    from tessera.operators.pinned import scratch
    from tessera.operators.step import score_step

    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_tax", "CAST(l_quantity > 25 AS DOUBLE) AS acc", "l_linenumber % 3 AS uses", "l_linenumber % 3 + l_partkey % 2 AS tries", "l_extendedprice AS len")
    path = scratch(spark, "step")
    got = score_step(rows, "l_orderkey", {"acc": F.col("acc"), "style": F.col("l_tax")}, {"acc": 2.0, "style": 0.5}, "acc", "uses", "tries", "len", 50000, path)
    names = {"rows": None, "acc_mean": 6, "style_nonzero_mean": 6, "correct_tool": None, "wrong_no_tool": None, "tool_group_std": 6, "tool_success_rate": 6, "truncated": None, "advantage_max": 5, "length_mean": 4}
    observed = [F.lit(got[n]).alias(n) if d is None else F.round(F.lit(got[n]), d).alias(n) for n, d in names.items()]
    return spark.read.parquet(path).agg(F.count_if(F.col("advantage") > 0.001).alias("written_above")).select(*observed, "written_above")
