"""Result-table and training metrics over ``lineitem``, ``part``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.plans.registry import Registry, table

registry = Registry()

_ROWS = """
e AS (SELECT l_returnflag AS eval, l_orderkey * 10 + l_linenumber AS sample_id, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS acc, l_linenumber % 4 AS uses, l_linenumber % 6 AS att,
  (l_partkey % 1000 + 28)::DOUBLE * (l_suppkey % 700 + 28) AS a0, CASE WHEN l_linenumber > 1 THEN (l_partkey % 100 + 28)::DOUBLE * (l_suppkey % 70 + 28) END AS a1,
  l_partkey % 90 AS c0, CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey % 50 END AS c1 FROM lineitem)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS eval",
        "l_orderkey * 10 + l_linenumber AS sample_id",
        "CASE WHEN l_linestatus = 'F' THEN 1D ELSE 0D END AS accuracy",
        "l_linenumber % 4 AS tool_use",
        "l_linenumber % 6 AS attempted_tool_use",
        "filter(array(named_struct('w', l_partkey % 1000 + 28, 'h', l_suppkey % 700 + 28), CASE WHEN l_linenumber > 1 THEN named_struct('w', l_partkey % 100 + 28, 'h', l_suppkey % 70 + 28) END), x -> x is not null) AS image_sizes",
        "filter(array(l_partkey % 90, CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey % 50 END), x -> x is not null) AS completion_len",
    )


def _agg(df: DataFrame, *by: str, **columns) -> DataFrame:
    return df.groupBy(*by).agg(*(F.round(c, 6).alias(n) for n, c in columns.items()))


@registry.query(f"WITH {_ROWS} SELECT eval, round(avg(acc) * 100, 6) AS accuracy FROM e GROUP BY eval")
def m_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg(_rows(spark, sf_dir), "eval", accuracy=M.accuracy())


@registry.query(f"WITH {_ROWS} SELECT eval, round(avg(CASE WHEN uses <= 1 THEN acc ELSE 0 END) * 100, 6) AS acc1, round(avg(CASE WHEN uses <= 2 THEN acc ELSE 0 END) * 100, 6) AS acc2 FROM e GROUP BY eval")
def m_accuracy_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg(_rows(spark, sf_dir), "eval", acc1=M.accuracy_at(1), acc2=M.accuracy_at(2))


@registry.query(f"WITH {_ROWS} SELECT eval, round(avg(CASE WHEN c1 IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS no_answer FROM e GROUP BY eval")
def m_no_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("no_answer", (F.size("completion_len") < 2).cast("double"))
    return _agg(rows, "eval", no_answer=M.accuracy("no_answer"))


@registry.query(f"WITH {_ROWS} SELECT eval, round(avg(uses), 6) AS avg_tool_use FROM e GROUP BY eval")
def m_avg_tool_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg(_rows(spark, sf_dir), "eval", avg_tool_use=M.avg_tool_use())


@registry.query("""
WITH b AS (SELECT event_type AS eval, user_id % 8 AS uses FROM events), n AS (SELECT eval, uses, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT eval, sum(n) AS total FROM n GROUP BY eval)
SELECT t.eval, g.bin::INT AS bin, round(round_even(coalesce(n.n, 0) / t.total::DOUBLE, 4) * 100, 6) AS share FROM t CROSS JOIN generate_series(0, 31) g(bin) LEFT JOIN n ON n.eval = t.eval AND n.uses = g.bin""")
def m_tool_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS eval", "CAST(user_id % 8 AS INT) AS tool_use")
    return M.tool_histogram(rows).withColumn("share", F.round("share", 6))


@registry.query(f"WITH {_ROWS} SELECT eval, round(avg(a0), 4) AS avg_size, max(a0) AS max_size, min(a0) AS min_size, round(quantile_cont(a0, 0.5), 4) AS median_size FROM e GROUP BY eval")
def m_image_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("eval").agg(F.round(M.image_size("avg"), 4).alias("avg_size"), M.image_size("max").alias("max_size"), M.image_size("min").alias("min_size"), F.round(M.image_size("median"), 4).alias("median_size"))


@registry.query(f"WITH {_ROWS} SELECT eval, round(avg(a1 / a0), 6) AS zoom_avg, round(quantile_cont(a1 / a0, 0.5), 6) AS zoom_median FROM e GROUP BY eval")
def m_zoom_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg(_rows(spark, sf_dir), "eval", zoom_avg=M.zoom_fraction("avg"), zoom_median=M.zoom_fraction("median"))


#: Tool calls in long form: one sample per order, one call per line.
_CALLS = "c AS (SELECT o_orderpriority AS eval, l_orderkey AS sample_id, l_linenumber - 1 AS call_idx, (l_partkey % 101) / 100.0::DOUBLE AS iou, (l_suppkey % 51) / 50.0::DOUBLE AS recall FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderpriority AS eval")
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").selectExpr("eval", "l_orderkey AS sample_id", "l_linenumber - 1 AS call_idx", "(l_partkey % 101) / 100D AS iou", "(l_suppkey % 51) / 50D AS recall")


@registry.query(f"WITH {_CALLS} SELECT eval, round(coalesce(round_even(avg(CASE WHEN call_idx = 0 THEN iou END), 4) * 100, 0), 4) AS ious, round(coalesce(round_even(avg(CASE WHEN call_idx = 0 THEN recall END), 4) * 100, 0), 4) AS recalls FROM c GROUP BY eval")
def m_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).groupBy("eval").agg(F.round(M.overlap_first("iou"), 4).alias("ious"), F.round(M.overlap_first("recall"), 4).alias("recalls"))


@registry.query(f"WITH {_CALLS}, l AS (SELECT eval, sample_id, max_by(iou, call_idx * 1000 + iou) AS x FROM c GROUP BY ALL) SELECT eval, round(coalesce(round_even(avg(x), 4) * 100, 0), 4) AS iou_last FROM l GROUP BY eval")
def m_overlap_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overlap_last(_calls(spark, sf_dir), "iou").withColumn("iou_last", F.round("iou_last", 4))


@registry.query(f"WITH {_CALLS}, m AS (SELECT eval, call_idx, round_even(avg(iou), 4) * 100 AS m FROM c GROUP BY ALL) SELECT eval, string_agg(format('{{:.2f}}', m), ';' ORDER BY call_idx) AS iou_distr FROM m GROUP BY eval")
def m_overlap_distr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overlap_by_call(_calls(spark, sf_dir), "iou")


@registry.query(f"WITH {_CALLS} SELECT eval, round(stddev_pop(CASE WHEN call_idx = 0 THEN iou END), 6) AS iou_std FROM c GROUP BY eval")
def m_overlap_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg(_calls(spark, sf_dir), "eval", iou_std=M.overlap_std("iou"))


@registry.query(f"WITH {_ROWS} SELECT eval, round(avg(c0 + coalesce(c1, 0)), 6) AS total_len, round(avg(c0), 6) AS first_len, round(avg(c1), 6) AS second_len FROM e GROUP BY eval")
def m_completion_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg(_rows(spark, sf_dir), "eval", total_len=M.completion_len("total"), first_len=M.completion_len("first"), second_len=M.completion_len("second"))


@registry.query("SELECT p_brand AS eval, round(CASE WHEN stddev_pop(p_size) * stddev_pop(p_retailprice) > 0 THEN corr(p_size, p_retailprice) END, 6) AS r FROM part GROUP BY p_brand")
def m_size_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("eval")).agg(F.round(M.correlation(F.col("p_size"), F.col("p_retailprice")), 6).alias("r"))


@registry.query(f"WITH {_ROWS} SELECT eval, round(avg(CASE WHEN uses > 0 THEN acc END), 6) AS acc_tool, round(avg(CASE WHEN uses = 0 THEN acc END), 6) AS acc_no_tool FROM e GROUP BY eval")
def m_acc_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg(_rows(spark, sf_dir), "eval", acc_tool=M.accuracy_if(True), acc_no_tool=M.accuracy_if(False))


@registry.query(f"WITH {_ROWS} SELECT eval, round(avg(CASE WHEN att <> 0 THEN uses / att::DOUBLE END), 6) AS tool_success FROM e GROUP BY eval")
def m_tool_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg(_rows(spark, sf_dir), "eval", tool_success=M.tool_success())


@registry.query(f"""
WITH {_ROWS}, n AS (SELECT DISTINCT l_returnflag AS eval FROM lineitem UNION SELECT 'Z')
SELECT n.eval, round(avg(acc) * 100, 6) AS accuracy, round(avg(CASE WHEN uses > 0 THEN acc END), 6) AS accuracy_if_tool_used, round(avg(c0), 6) AS avg_first_completion_len FROM n LEFT JOIN e USING (eval) GROUP BY n.eval""")
def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    evals = rows.select("eval").distinct().union(spark.sql("SELECT 'Z'"))
    names = ["accuracy", "accuracy_if_tool_used", "avg_first_completion_len"]
    out = M.results_table(evals, M.results(rows, names), names)
    return out.select("eval", *(F.round(n, 6).alias(n) for n in names))


@registry.query("WITH g AS (SELECT l_orderkey, avg(l_linenumber % 3) AS m FROM lineitem GROUP BY 1) SELECT round(stddev_pop(m), 6) AS tool_group_std FROM g")
def t_tool_group_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber % 3 AS tool_use")
    return M.group_tool_spread(rows, "l_orderkey").withColumn("tool_group_std", F.round("tool_group_std", 6))


@registry.query("SELECT l_linenumber, round(coalesce(avg(CASE WHEN l_linenumber % 6 <> 0 AND l_linenumber < 5 THEN (l_partkey % 3) / (l_linenumber % 6)::DOUBLE END), -1), 6) AS rate FROM lineitem GROUP BY l_linenumber")
def t_tool_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber", "l_partkey % 3 AS tool_use", "CASE WHEN l_linenumber < 5 THEN l_linenumber % 6 ELSE 0 END AS attempted_tool_use")
    return _agg(rows, "l_linenumber", rate=M.tool_success(default=-1.0))


@registry.query("SELECT event_type, round(avg(CASE WHEN user_id % 5 > 0 THEN value END), 6) AS len_mean FROM events GROUP BY event_type")
def t_len_nanmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_type", "CASE WHEN user_id % 5 > 0 THEN value ELSE double('NaN') END AS x")
    return _agg(rows, "event_type", len_mean=M.nanmean(F.col("x")))


@registry.query("SELECT l_returnflag, round(avg(l_discount), 6) AS mean_reward, round(coalesce(avg(nullif(l_tax, 0)), -1), 6) AS nonzero_mean, round(coalesce(avg(nullif(l_linenumber * 0, 0)), -1), 6) AS none_mean FROM lineitem GROUP BY l_returnflag")
def t_reward_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg(table(spark, sf_dir, "lineitem"), "l_returnflag", mean_reward=F.avg("l_discount"), nonzero_mean=M.nonzero_mean(F.col("l_tax")), none_mean=M.nonzero_mean(F.col("l_linenumber") * 0))


@registry.query(f"WITH {_ROWS} SELECT eval, count(*) FILTER (acc > 0.5 AND uses > 0) AS correct_tool, count(*) FILTER (acc > 0.5 AND uses = 0) AS correct_no_tool, count(*) FILTER (acc <= 0.5 AND uses > 0) AS wrong_tool, count(*) FILTER (acc <= 0.5 AND uses = 0) AS wrong_no_tool FROM e GROUP BY eval")
def t_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("eval").agg(*(c.alias(n) for n, c in M.confusion(F.col("accuracy"), F.col("tool_use")).items()))


@registry.query("SELECT event_id // 100 AS step, event_type AS key, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def t_log_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id div 100 AS step", "event_type AS key", "value")
    return _agg(rows, "step", "key", mean=F.avg("value"))


@registry.query("SELECT label, count(*) FILTER (len(list_filter(embedding, lambda x: x > 0)) >= 32) AS truncated FROM embeddings GROUP BY label")
def t_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select("label", F.filter("embedding", lambda x: x > 0).alias("ids"))
    return ids.groupBy("label").agg(M.truncated("ids", 32).alias("truncated"))


@registry.query("SELECT l_returnflag, round(avg(d), 6) AS mean, round(max(d), 6) AS max, round(min(d), 6) AS min, round(sum(d), 4) AS sum, " + ", ".join(f"round(quantile_cont(d, {i / 10}), 6) AS q{i}" for i in range(1, 10)) + " FROM (SELECT l_returnflag, l_discount - l_tax AS d FROM lineitem) GROUP BY l_returnflag")
def t_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_discount - l_tax AS d")
    return rows.groupBy("l_returnflag").agg(*(F.round(c, 4 if n == "sum" else 6).alias(n) for n, c in M.spread(F.col("d")).items()))


@registry.query("""
WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS ry FROM part)
SELECT p_brand, round(CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS rho FROM r GROUP BY p_brand""")
def t_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spearman(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice").withColumn("rho", F.round("rho", 6))


@registry.query("SELECT event_type, count(*) FILTER (user_id % 7 = 0 OR user_id % 11 = 0) AS n_bad, min(event_id) FILTER (user_id % 7 = 0 OR user_id % 11 = 0) AS first_bad FROM events GROUP BY event_type")
def t_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_type", "event_id", "CASE WHEN user_id % 7 = 0 THEN double('NaN') WHEN user_id % 11 = 0 THEN double('-Infinity') ELSE value END AS x")
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    return rows.groupBy("event_type").agg(M.nonfinite(F.col("x")).alias("n_bad"), F.min(F.when(bad, F.col("event_id"))).alias("first_bad"))


@registry.query("SELECT label, bool_or(len(list_filter(embedding, lambda x: x > 0.25)) = 0) AS has_zero FROM embeddings GROUP BY label")
def t_mask_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: (x > 0.25).cast("int")).alias("mask"))
    return rows.groupBy("label").agg(M.any_all_zero("mask").alias("has_zero"))
