"""Rewards, advantages, losses, samplers and the replay buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import policy as P
from tessera.plans.registry import Registry, table

registry = Registry()

_LINES = """
l AS (SELECT l_orderkey AS grp, l_linenumber AS n, l_partkey AS pk, l_suppkey AS sk, CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0 END AS acc, l_quantity / 50.0::DOUBLE AS r, l_discount AS disc, l_linenumber % 3 AS uses FROM lineitem)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS grp", "l_linenumber AS n", "l_partkey AS pk", "l_suppkey AS sk", "CASE WHEN l_quantity > 25 THEN 1D ELSE 0D END AS acc", "l_quantity / 50D AS r", "l_discount AS disc", "l_linenumber % 3 AS uses")


_CURIOUS = "greatest(0.3 - avg(CASE WHEN uses > 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY grp), 0) * CASE WHEN uses > 0 THEN 1 ELSE 0 END"


@registry.query(f"""
WITH {_LINES}, c AS (SELECT grp, n, pk, sk, acc, least(1 - uses, 0) AS pen, {_CURIOUS} AS cur FROM l)
SELECT grp, n, pk, sk, round(acc + 0.05 * pen + 0.5 * cur, 6) AS reward, round(acc + 0.05 * pen, 6) AS for_sampling FROM c""")
def g_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"accuracy": F.col("acc"), "pr_penalty": P.penalty(F.col("uses"), 1), "curiosity": P.curiosity("uses", "grp", 0.3)}
    weights, usage = {"accuracy": 1.0, "pr_penalty": 0.05, "curiosity": 0.5}, {"curiosity": "reward"}
    total = lambda part: F.round(P.weighted(parts, weights, usage, part), 6)
    return _lines(spark, sf_dir).select("grp", "n", "pk", "sk", total("reward").alias("reward"), total("sampling_weights").alias("for_sampling"))


@registry.query(f"WITH {_LINES} SELECT grp, n, pk, sk, CASE WHEN acc > 0.5 THEN disc ELSE 0 END AS reward FROM l")
def g_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("grp", "n", "pk", "sk", P.conditional(F.col("disc"), F.col("acc")).alias("reward"))


_ADV = "(r - avg(r) OVER (PARTITION BY grp)) / (stddev_samp(r) OVER (PARTITION BY grp) + 1e-4)"


@registry.query(f"WITH {_LINES} SELECT grp, n, pk, sk, round({_ADV}, 5) AS advantage FROM l")
def g_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("grp", "n", "pk", "sk", F.round(P.advantage(F.col("r"), "grp"), 5).alias("advantage"))


@registry.query(f"WITH {_LINES} SELECT grp, n, pk, sk, round(abs({_ADV}), 5) AS weight FROM l")
def g_sampling_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("grp", "n", "pk", "sk", F.round(P.sampling_weight(F.col("r"), "grp"), 5).alias("weight"))


@registry.query(f"WITH {_LINES} SELECT grp, n, pk, sk, round({_CURIOUS}, 6) AS reward FROM l")
def r_curiosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("grp", "n", "pk", "sk", F.round(P.curiosity("uses", "grp", 0.3), 6).alias("reward"))


@registry.query(f"WITH {_LINES} SELECT grp, n, pk, sk, least(1 - uses, 0) AS reward FROM l")
def r_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("grp", "n", "pk", "sk", P.penalty(F.col("uses"), 1).alias("reward"))


@registry.query(f"WITH {_LINES} SELECT grp, n, pk, sk, CASE WHEN uses > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reward FROM l")
def r_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("grp", "n", "pk", "sk", P.constant_exploration(F.col("uses")).alias("reward"))


_TOKENS = "t AS (SELECT l_orderkey AS row_id, -l_discount * 10 AS lp, -l_tax * 10 AS old, -l_discount * 8 AS ref, (l_orderkey % 5 - 2)::DOUBLE AS adv, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE 1 END AS mask FROM lineitem)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS row_id", "-l_discount * 10 AS lp", "-l_tax * 10 AS old", "-l_discount * 8 AS ref", "CAST(l_orderkey % 5 - 2 AS DOUBLE) AS adv", "CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE 1 END AS mask")


@registry.query(f"""
WITH {_TOKENS}, p AS (SELECT row_id, mask, exp(lp - old) AS ra, adv, exp(ref - lp) - (ref - lp) - 1 AS kl FROM t),
q AS (SELECT row_id, mask, kl, ra * adv AS a, greatest(0.8, least(ra, 1.2)) * adv AS b FROM p),
r AS (SELECT row_id, sum(mask * (-least(a, b) + 0.04 * kl)) / nullif(sum(mask), 0) AS loss, sum(mask * kl) / nullif(sum(mask), 0) AS kl, sum(mask * CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0 END) / nullif(sum(mask), 0) AS clipped FROM q GROUP BY row_id)
SELECT round(avg(loss), 6) AS loss, round(avg(kl), 6) AS kl, round(avg(clipped), 6) AS clipped FROM r""")
def loss_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.grpo_loss(_tokens(spark, sf_dir), "row_id")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@registry.query("""
WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)[2:] AS mask FROM embeddings),
t AS (SELECT vec_id, generate_subscripts(mask, 1) - 1 AS i, unnest(mask) AS mask FROM m)
SELECT vec_id, i::INT AS i, mask, CASE WHEN vec_id % 2 = 0 AND i >= 5 AND i < 9 THEN 0.5::DOUBLE ELSE (vec_id % 7)::DOUBLE END AS adv FROM t""")
def loss_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("mask", P.shift_mask(F.transform("embedding", lambda x: (x > 0).cast("int"))))
    value = F.when(F.col("vec_id") % 2 == 0, F.lit(0.5))
    adv = P.override_span((F.col("vec_id") % 7).cast("double"), F.col("mask"), value, F.lit(5), F.lit(9))
    return rows.select("vec_id", F.posexplode(F.arrays_zip("mask", adv.alias("adv"))).alias("i", "t")).select("vec_id", "i", "t.mask", "t.adv")


@registry.query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS g, vec_id % len(embedding) AS i FROM embeddings), z AS (SELECT vec_id, g, i, list_max(g) AS top, list_sum(list_transform(g, lambda x: exp(x - list_max(g)))) AS s FROM v)
SELECT vec_id, round(g[i + 1] - top - ln(s), 5) AS logp, round(ln(s) - list_sum(list_transform(g, lambda x: exp(x - top) * (x - top))) / s, 5) AS entropy FROM z""")
def logsoftmax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", g.alias("g"))
    return rows.select("vec_id", F.round(P.log_softmax(F.col("g"), (F.col("vec_id") % F.size("g")).cast("int")), 5).alias("logp"), F.round(P.entropy(F.col("g")), 5).alias("entropy"))


@registry.query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: x::DOUBLE) AS p, list_transform(embedding[13:24], lambda x: x::DOUBLE) AS a, CASE WHEN vec_id % 3 > 0 THEN list_transform(embedding[25:36], lambda x: x::DOUBLE) END AS b FROM embeddings),
e AS (SELECT vec_id, unnest(p) AS p, unnest(a) AS a, unnest(CASE WHEN b IS NULL THEN list_transform(p, lambda x: NULL::DOUBLE) ELSE b END) AS b FROM v),
s AS (SELECT vec_id, ln(exp(p) + exp(p)) AS top, ln(exp(p) + exp(a)) AS below, b FROM e)
SELECT vec_id, round(sum(CASE WHEN b IS NULL THEN top - below ELSE ln(exp(top) + exp(b)) - ln(exp(below) + exp(b)) END), 5) AS score, CASE WHEN count(b) > 0 THEN round(sum(ln(exp(top) + exp(b)) - ln(exp(below) + exp(b))), 5) END AS strict_score FROM s GROUP BY vec_id""")
def r_infonce(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda at: F.transform(F.slice("embedding", at, 12), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", part(1).alias("p"), part(13).alias("a"), F.when(F.col("vec_id") % 3 > 0, part(25)).alias("b"))
    total = lambda strict: F.round(F.aggregate(P.infonce(F.col("p"), [F.col("a"), F.col("b")], strict), F.lit(0.0), lambda s, x: s + x), 5)
    return rows.select("vec_id", total(False).alias("score"), total(True).alias("strict_score"))


@registry.query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), e AS (SELECT vec_id, generate_subscripts(d, 1) AS i, unnest(d) AS x FROM v),
k AS (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS rk FROM e)
SELECT vec_id, round(avg(CASE WHEN x > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, round(quantile_cont(greatest(-0.1, least(x, 0.1)) - 0.02, 0.3), 6) AS quantile, round(tanh(sum(greatest(-0.1, least(x, 0.1)) - 0.02)), 6) AS clipped,
  round(sum(CASE WHEN i <= 5 THEN x END) * (2.0 / 5), 6) AS first5, round(sum(CASE WHEN rk <= 3 THEN x END), 6) AS top3, CASE WHEN sum(x) < 0 THEN -1.0::DOUBLE ELSE 1.0 END AS sign FROM k GROUP BY vec_id""")
def r_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("d"))
    d = F.col("d")
    return rows.select(
        "vec_id",
        F.round(P.contrast_reward(d, delta=0.05), 6).alias("share"),
        F.round(P.contrast_reward(d, q=0.3, gamma=0.1, tau=0.02), 6).alias("quantile"),
        F.round(P.contrast_reward(d, gamma=0.1, tau=0.02, tanh=True), 6).alias("clipped"),
        F.round(P.contrast_reward(d, select_k=5, select="first", length_factor="len", scaling=2.0), 6).alias("first5"),
        F.round(P.contrast_reward(d, select_k=3, select="max"), 6).alias("top3"),
        P.contrast_reward(d, discretize=True).alias("sign"),
    )


@registry.query("SELECT event_id, round(CASE WHEN event_id < 1000 THEN 0 WHEN event_id > 5000 THEN 1 ELSE 0.175::DOUBLE * (event_id - 1000) / 4000.0::DOUBLE END, 8) AS target FROM events")
def f_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(P.curriculum(F.col("event_id"), 1000, 5000, 0.175), 8).alias("target"))


@registry.query("""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS total FROM orders), c AS (SELECT o_orderkey, (rn - 1) // 35 AS chunk, (rn - 1) % 35 AS pos FROM n WHERE rn <= total // 35 * 35)
SELECT o_orderkey, chunk, pos, rep::INT AS rep, mini::INT AS mini FROM c, generate_series(0, 3) r(rep), generate_series(0, 1) m(mini)""")
def repeat_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.repeat_sampler(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", batch=35, repeat=4, mini_repeat=2)


@registry.query("SELECT o_orderkey, c::INT AS copy FROM orders, generate_series(0, 7) g(c)")
def repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.repeat_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 8)


@registry.query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 200 AS batch FROM orders")
def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mini_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 200)


@registry.query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 100 AND rn <= 1100")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.row_range(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 1100)


@registry.query("SELECT DISTINCT o_custkey FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos = 0")
def dedup_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pos"))
    return P.dedup_prompts(rows, "o_custkey", "pos").select("o_custkey")


def _draw_sql(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / {float(16**13)})"


@registry.query(f"SELECT o_orderkey, CASE WHEN {_draw_sql('7', 'o_orderkey')} < 0.1 THEN 'validation' ELSE 'train' END AS part FROM orders")
def split_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.1, seed=7)


@registry.query(f"SELECT o_orderkey FROM (SELECT o_orderkey, -ln(greatest({_draw_sql('3', 'o_orderkey')}, 1e-15)) / (o_custkey % 10) AS k FROM orders WHERE o_custkey % 10 > 0) ORDER BY k, o_orderkey LIMIT 500")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_custkey % 10 AS DOUBLE) AS w")
    return P.weighted_sample(rows, "o_orderkey", "w", 500, seed=3).select("o_orderkey")


@registry.query(f"""
WITH c AS (SELECT o_orderkey, w, sum(w) OVER (ORDER BY o_orderkey) AS hi FROM (SELECT o_orderkey, (o_custkey % 10)::DOUBLE AS w FROM orders)), t AS (SELECT max(hi) AS total FROM c),
d AS (SELECT id AS draw, {_draw_sql('5', 'id')} * total AS place FROM range(300) r(id), t)
SELECT draw, o_orderkey FROM d JOIN c ON place < hi AND place >= hi - w""")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_custkey % 10 AS DOUBLE) AS w")
    return P.weighted_draws(rows, "o_orderkey", "w", 300, seed=5).select("draw", "o_orderkey")


@registry.query("""
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events), s AS (SELECT event_id, (n - 1) % 40 AS slot, row_number() OVER (PARTITION BY (n - 1) % 40 ORDER BY n DESC) AS k FROM n)
SELECT event_id, slot, slot < 8 AS in_first_read FROM s WHERE k = 1""")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = P.ring_buffer(table(spark, sf_dir, "events").select("event_id"), "event_id", 40)
    first = P.buffer_read(held, 0, 8).select("slot", F.lit(True).alias("hit"))
    return held.join(first, "slot", "left").select("event_id", "slot", F.coalesce("hit", F.lit(False)).alias("in_first_read"))
