"""Geometry over boxes derived from ``lineitem`` and ``orders`` keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.plans.registry import Registry, table

registry = Registry()

_KEYS = ("l_orderkey", "l_linenumber")
#: Predicted and gold integer boxes of a line item.
_BOXES = """
b AS (SELECT l_orderkey, l_linenumber,
  CAST(l_partkey % 90 AS INT) px1, CAST(l_suppkey % 70 AS INT) py1, CAST(l_partkey % 90 + l_linenumber * 9 AS INT) px2, CAST(l_suppkey % 70 + l_partkey % 41 AS INT) py2,
  CAST(l_suppkey % 80 AS INT) gx1, CAST(l_partkey % 60 AS INT) gy1, CAST(l_suppkey % 80 + l_orderkey % 50 AS INT) gx2, CAST(l_partkey % 60 + l_linenumber * 7 AS INT) gy2
  FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lambda e: F.expr(f"CAST({e} AS INT)")
    pred = G.box(i("l_partkey % 90"), i("l_suppkey % 70"), i("l_partkey % 90 + l_linenumber * 9"), i("l_suppkey % 70 + l_partkey % 41"))
    gold = G.box(i("l_suppkey % 80"), i("l_partkey % 60"), i("l_suppkey % 80 + l_orderkey % 50"), i("l_partkey % 60 + l_linenumber * 7"))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, pred.alias("pred"), gold.alias("gold"))


def _flat(b, *, digits: int | None = None) -> list:
    part = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return [part(b[c]).alias(c) for c in ("x1", "y1", "x2", "y2")]


@registry.query(f"""
WITH {_BOXES}, a AS (SELECT *, CASE WHEN least(px2,gx2) < greatest(px1,gx1) OR least(py2,gy2) < greatest(py1,gy1) THEN 0
  ELSE (least(px2,gx2) - greatest(px1,gx1)) * (least(py2,gy2) - greatest(py1,gy1)) END AS i, (px2-px1)*(py2-py1) AS p, (gx2-gx1)*(gy2-gy1) AS g FROM b)
SELECT l_orderkey, l_linenumber, round(CASE WHEN p+g-i > 0 THEN i * 1.0 / (p+g-i) ELSE 0 END, 6)::DOUBLE AS iou,
  round(CASE WHEN p > 0 THEN i * 1.0 / p ELSE 0 END, 6)::DOUBLE AS prec, round(CASE WHEN g > 0 THEN i * 1.0 / g ELSE 0 END, 6)::DOUBLE AS recall FROM a""")
def b_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _boxes(spark, sf_dir).withColumn("o", G.overlap(F.col("pred"), F.col("gold")))
    return o.select(*_KEYS, F.round("o.iou", 6).alias("iou"), F.round("o.precision", 6).alias("prec"), F.round("o.recall", 6).alias("recall"))


@registry.query(f"""
WITH {_BOXES}, a AS (SELECT *, greatest(0, least(px2,gx2) - greatest(px1,gx1)) * greatest(0, least(py2,gy2) - greatest(py1,gy1)) AS i,
  greatest(0,px2-px1)*greatest(0,py2-py1) AS p, greatest(0,gx2-gx1)*greatest(0,gy2-gy1) AS g FROM b)
SELECT l_orderkey, l_linenumber, round(CASE WHEN p+g-i > 0 THEN i * 1.0 / (p+g-i) ELSE 0 END, 6)::DOUBLE AS iou, round(CASE WHEN g > 0 THEN i * 1.0 / g ELSE 0 END, 6)::DOUBLE AS recall FROM a""")
def b_iou_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = F.col("gold"), F.col("pred")
    return _boxes(spark, sf_dir).select(*_KEYS, F.round(G.overlap_int(gold, pred), 6).alias("iou"), F.round(G.overlap_int(gold, pred, "recall"), 6).alias("recall"))


@registry.query("""
WITH c AS (SELECT o_orderkey, CAST(o_orderkey % 64 AS INT) AS cell, CAST(o_custkey % 8 + 1 AS INT) AS per_row, CAST(o_custkey % 3 * 64 + 64 AS INT) AS size FROM orders)
SELECT o_orderkey, cell % per_row * size AS x1, cell // per_row * size AS y1, (cell % per_row + 1) * size AS x2, (cell // per_row + 1) * size AS y2 FROM c""")
def b_cell_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 64 AS INT) cell", "CAST(o_custkey % 8 + 1 AS INT) per_row", "CAST(o_custkey % 3 * 64 + 64 AS INT) size")
    return c.withColumn("b", G.cell_box(F.col("cell"), F.col("per_row"), F.col("size"))).select("o_orderkey", *_flat(F.col("b")))


#: Boxes that are relative for two rows of three, with an input and an original size.
_MIXED = """
m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 < 2 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS k, CAST(l_suppkey % 400 + 300 AS INT) AS iw, CAST(l_partkey % 500 + 200 AS INT) AS ih,
  CAST(l_suppkey % 400 * 2 + 700 AS INT) AS w, CAST(l_partkey % 500 * 2 + 500 AS INT) AS h,
  (l_partkey % 40)::DOUBLE AS a1, (l_suppkey % 30)::DOUBLE AS b1, (l_partkey % 40 + l_linenumber * 8)::DOUBLE AS a2, (l_suppkey % 30 + l_orderkey % 60)::DOUBLE AS b2 FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, iw, ih, w, h, a1 / k AS x1, b1 / k AS y1, a2 / k AS x2, b2 / k AS y2 FROM m),
f AS (SELECT *, (x1 < 1 AND y1 < 1 AND x2 < 1 AND y2 < 1) AS rel, least(0.1, 30.0 / iw) AS px, least(0.1, 30.0 / ih) AS py FROM r),
n AS (SELECT *, least(greatest(0.0, (CASE WHEN rel THEN x1 ELSE x1 / iw END) - px), 1.0) AS nx1, least(greatest(0.0, (CASE WHEN rel THEN y1 ELSE y1 / ih END) - py), 1.0) AS ny1,
  least(greatest(0.0, (CASE WHEN rel THEN x2 ELSE x2 / iw END) + px), 1.0) AS nx2, least(greatest(0.0, (CASE WHEN rel THEN y2 ELSE y2 / ih END) + py), 1.0) AS ny2 FROM f)"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").selectExpr(
        *_KEYS, "CASE WHEN l_partkey % 3 < 2 THEN 100D ELSE 1D END k", "CAST(l_suppkey % 400 + 300 AS INT) iw", "CAST(l_partkey % 500 + 200 AS INT) ih", "CAST(l_suppkey % 400 * 2 + 700 AS INT) w", "CAST(l_partkey % 500 * 2 + 500 AS INT) h",
        "l_partkey % 40 a1", "l_suppkey % 30 b1", "l_partkey % 40 + l_linenumber * 8 a2", "l_suppkey % 30 + l_orderkey % 60 b2",
    )
    b = G.box(F.col("a1") / F.col("k"), F.col("b1") / F.col("k"), F.col("a2") / F.col("k"), F.col("b2") / F.col("k"))
    pad = F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"))
    m = m.select(*_KEYS, "iw", "ih", "w", "h", b.alias("b")).withColumn("pad", G.effective_padding(pad, F.col("iw"), F.col("ih"), 30.0))
    return m.withColumn("norm", G.normalized(F.col("b"), F.col("pad"), F.col("iw"), F.col("ih")))


@registry.query(f"WITH {_MIXED} SELECT l_orderkey, l_linenumber, CASE WHEN rel THEN 'relative' ELSE 'absolute_resized' END AS bbox_mode FROM f")
def b_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select(*_KEYS, G.mode(F.col("b")).alias("bbox_mode"))


@registry.query(f"WITH {_MIXED} SELECT l_orderkey, l_linenumber, round(px, 6)::DOUBLE AS px, round(py, 6)::DOUBLE AS py FROM f")
def b_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select(*_KEYS, F.round("pad.x", 6).alias("px"), F.round("pad.y", 6).alias("py"))


@registry.query(f"WITH {_MIXED} SELECT l_orderkey, l_linenumber, round(nx1, 6)::DOUBLE AS x1, round(ny1, 6)::DOUBLE AS y1, round(nx2, 6)::DOUBLE AS x2, round(ny2, 6)::DOUBLE AS y2 FROM n")
def b_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select(*_KEYS, *_flat(F.col("norm"), digits=6))


@registry.query(f"""
WITH {_MIXED}, p AS (SELECT l_orderkey, l_linenumber, w, h, greatest(0, least(trunc(nx1 * w)::INT, w - 1)) AS x1, greatest(0, least(trunc(ny1 * h)::INT, h - 1)) AS y1,
  greatest(1, least(trunc(nx2 * w)::INT, w)) AS x2, greatest(1, least(trunc(ny2 * h)::INT, h)) AS y2 FROM n)
SELECT l_orderkey, l_linenumber, x1, y1, CASE WHEN x2 <= x1 THEN least(w, x1 + 1) ELSE x2 END AS x2, CASE WHEN y2 <= y1 THEN least(h, y1 + 1) ELSE y2 END AS y2 FROM p""")
def b_pixel_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).withColumn("p", G.pixel_box(F.col("norm"), F.col("w"), F.col("h"))).select(*_KEYS, *_flat(F.col("p")))


@registry.query(f"""
WITH {_MIXED}, z AS (SELECT l_orderkey, l_linenumber, trunc(nx1 * w)::INT AS x1, trunc(ny1 * h)::INT AS y1, trunc(nx2 * w)::INT AS x2, trunc(ny2 * h)::INT AS y2 FROM n)
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2 FROM (SELECT *, x2 - x1 > 28 AND y2 - y1 > 28 AS ok FROM z)""")
def b_zoom_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"))
    cut = G.zoom_box(F.col("b"), pad, F.col("iw"), F.col("ih"), F.col("w"), F.col("h"), 30.0)
    return _mixed(spark, sf_dir).withColumn("c", cut).select(*_KEYS, *_flat(F.col("c")))


@registry.query(f"""
WITH {_MIXED}, i AS (SELECT l_orderkey, l_linenumber, least(greatest(0.0, nx1 + 0.05), 1.0) AS x1, least(greatest(0.0, ny1 + 0.08), 1.0) AS y1, least(greatest(0.0, nx2 - 0.05), 1.0) AS x2, least(greatest(0.0, ny2 - 0.08), 1.0) AS y2 FROM n)
SELECT l_orderkey, l_linenumber, round(x1, 6)::DOUBLE AS x1, round(y1, 6)::DOUBLE AS y1, round(CASE WHEN x2 <= x1 THEN least(1.0, x1 + 1e-6) ELSE x2 END, 6)::DOUBLE AS x2, round(CASE WHEN y2 <= y1 THEN least(1.0, y1 + 1e-6) ELSE y2 END, 6)::DOUBLE AS y2 FROM i""")
def b_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = F.struct(F.lit(0.05).alias("x"), F.lit(0.08).alias("y"))
    return _mixed(spark, sf_dir).withColumn("v", G.invert_padding(F.col("norm"), pad)).select(*_KEYS, *_flat(F.col("v"), digits=6))


@registry.query(f"""
WITH {_MIXED}, e AS (SELECT l_orderkey, l_linenumber, iw, ih, round_even(nx1 * iw, 0)::INT AS x1, round_even(ny1 * ih, 0)::INT AS y1, round_even(nx2 * iw, 0)::INT AS x2, round_even(ny2 * ih, 0)::INT AS y2 FROM n),
g AS (SELECT l_orderkey, l_linenumber, iw, ih, x1, y1, CASE WHEN x2 <= x1 THEN x1 + 1 ELSE x2 END AS x2, CASE WHEN y2 <= y1 THEN y1 + 1 ELSE y2 END AS y2 FROM e)
SELECT l_orderkey, l_linenumber, greatest(0, least(x1, iw - 1)) AS x1, greatest(0, least(y1, ih - 1)) AS y1, greatest(1, least(x2, iw)) AS x2, greatest(1, least(y2, ih)) AS y2 FROM g""")
def b_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).withColumn("e", G.emit(F.col("norm"), F.col("iw"), F.col("ih"))).select(*_KEYS, *_flat(F.col("e")))


@registry.query("""
WITH s AS (SELECT o_orderkey, CAST(o_custkey % 9000 + 5 AS INT) AS w, CAST(o_orderkey % 9000 + 50 AS INT) AS h FROM orders),
t AS (SELECT *, greatest(28, round_even(w / 28.0, 0)::INT * 28) AS w0, greatest(28, round_even(h / 28.0, 0)::INT * 28) AS h0, sqrt(w::DOUBLE * h / 12845056.0) AS sh, sqrt(3136.0::DOUBLE / (w::DOUBLE * h)) AS gr FROM s WHERE greatest(w, h) <= 200 * least(w, h))
SELECT o_orderkey, CASE WHEN w0::DOUBLE * h0 > 12845056 THEN greatest(28, floor(w / sh / 28)::INT * 28) WHEN w0::DOUBLE * h0 < 3136 THEN ceil(w * gr / 28)::INT * 28 ELSE w0 END AS rw,
  CASE WHEN w0::DOUBLE * h0 > 12845056 THEN greatest(28, floor(h / sh / 28)::INT * 28) WHEN w0::DOUBLE * h0 < 3136 THEN ceil(h * gr / 28)::INT * 28 ELSE h0 END AS rh FROM t""")
def b_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_custkey % 9000 + 5 AS INT) w", "CAST(o_orderkey % 9000 + 50 AS INT) h").where("greatest(w, h) <= 200 * least(w, h)")
    return s.withColumn("r", G.smart_resize(F.col("h"), F.col("w"))).select("o_orderkey", F.col("r.w").alias("rw"), F.col("r.h").alias("rh"))


@registry.query("""
WITH s AS (SELECT o_orderkey, CAST(o_custkey % 90 + 5 AS INT) AS w, CAST(o_orderkey % 90 + 5 AS INT) AS h FROM orders)
SELECT o_orderkey, CASE WHEN least(w,h) >= 28 THEN w WHEN w <= h THEN 28 ELSE trunc(w * (28.0::DOUBLE / least(w,h)))::INT END AS mw, CASE WHEN least(w,h) >= 28 THEN h WHEN h <= w THEN 28 ELSE trunc(h * (28.0::DOUBLE / least(w,h)))::INT END AS mh FROM s""")
def b_min_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_custkey % 90 + 5 AS INT) w", "CAST(o_orderkey % 90 + 5 AS INT) h")
    return s.withColumn("m", G.min_side(F.col("w"), F.col("h"))).select("o_orderkey", F.col("m.w").alias("mw"), F.col("m.h").alias("mh"))


@registry.query("SELECT o_orderkey, round((o_custkey % 512 + 64) / (sin(radians(abs(o_orderkey % 91 - 45))) + cos(radians(abs(o_orderkey % 91 - 45)))), 4)::DOUBLE AS side FROM orders")
def b_rotate_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(G.rotation_safe_side(F.expr("o_custkey % 512 + 64"), F.expr("o_orderkey % 91 - 45")), 4).alias("side"))
