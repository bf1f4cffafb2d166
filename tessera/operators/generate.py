"""Synthetic grid tasks: configurations, cell labels, questions and negative boxes, all by hashed draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geometry as G
from tessera.operators import tries as tries_of
from tessera.operators.numbering import numbered
from tessera.operators.policy import draw

# The axes of the grid configurations and the texts of the questions.
SIZES, GRIDS = (1024, 2048, 4096, 8192), (1, 2, 4, 8, 16)
PREAMBLE = "In the image you see a grid, whose cells are numbered from left to right and top to bottom. In each cell, the cell's index is printed in the upper left corner. "
#: Least side of a free-floating box.
MIN_SIDE = 28
CLASSES = ("Muffin", "Chihuahua")
OUTLIER = "In all cells except one you see a Chihuahua. Which cell does not contain a Chihuahua, but a Muffin?\nAnswer only with the cell number."


def seed_of(base: int, config: Column, modulus: int = 1_000_000) -> Column:
    """base + sha256(config) % modulus, digit by digit."""
    digits = F.transform(F.filter(F.split(F.sha2(config, 256), ""), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.lit(base) + F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % modulus)


def grid_configs(spark: SparkSession, sizes=SIZES, grids=GRIDS) -> DataFrame:
    """Image size x grid size x {1 sample of class 0, half of the cells where there are more than one}."""
    axes = spark.range(1).select(F.explode(F.array(*map(F.lit, sizes))).alias("big_image_size")).withColumn("grid_size", F.explode(F.array(*map(F.lit, grids))))
    cells = F.col("grid_size") * F.col("grid_size")
    samples = F.when(F.col("grid_size") > 1, F.array(F.lit(1), F.floor(cells / 2).cast("int"))).otherwise(F.array(F.lit(1)))
    return axes.withColumn("num_samples_class_0", F.explode(samples))


def config_key() -> Column:
    return F.concat_ws("_", "big_image_size", "grid_size", "num_samples_class_0")


def cells(configs: DataFrame, images: int, base_seed: int = 42) -> DataFrame:
    """One row per configuration, image and cell with its label; 0 is class 0.

    A grid of one cell has class 0 in the second half of the images; others in
    the ``num_samples_class_0`` cells of least draw.
    """
    rows = configs.withColumn("img", F.explode(F.sequence(F.lit(0), F.lit(images - 1)))).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("grid_size") * F.col("grid_size") - 1)))
    keyed = rows.withColumn("config", config_key()).withColumn("_d", draw(base_seed, "config", "img", "cell"))
    rank = F.row_number().over(Window.partitionBy("config", "img").orderBy("_d", "cell"))
    label = F.when(F.col("grid_size") == 1, (F.col("img") < images // 2).cast("int")).otherwise((rank > F.col("num_samples_class_0")).cast("int"))
    return keyed.withColumn("label", label).drop("_d")


def files_for(cells_: DataFrame, index: DataFrame, base_seed: int = 42) -> DataFrame:
    """A source file for each cell, drawn from its class' files (label, image) in name order."""
    placed = numbered(index, "label", "image")
    sizes = placed.groupBy("label").agg(F.count("*").alias("size"), F.min("rn").alias("first"))
    drawn = cells_.join(F.broadcast(sizes), "label").withColumn("n", F.floor(draw(f"{base_seed}f", "config", "img", "cell") * F.col("size")) + F.col("first"))
    return drawn.join(placed.withColumnRenamed("rn", "n"), ["label", "n"]).drop("n", "size", "first")


def single_cell_queries(cells_: DataFrame, images: int, base_seed: int = 42) -> DataFrame:
    """Which class is in a cell: class 0 for the first half of the images, class 1 for the second."""
    fit = cells_.where((F.col("num_samples_class_0") != 1) | (F.col("grid_size") == 1))
    wanted = F.when(F.col("grid_size") == 1, F.col("label")).otherwise((F.col("img") >= images // 2).cast("int"))
    drawn = fit.where(F.col("label") == wanted).withColumn("_d", draw(f"{base_seed}q", "config", "img", "cell"))
    chosen = drawn.groupBy("config", "img", "grid_size", "big_image_size").agg(F.min(F.struct("_d", "cell", "label")).alias("c")).select("config", "img", "grid_size", "big_image_size", "c.cell", "c.label")
    first = draw(f"{base_seed}o", "config", "img") > 0.5
    a, b = F.when(first, CLASSES[0]).otherwise(CLASSES[1]), F.when(first, CLASSES[1]).otherwise(CLASSES[0])
    answer = F.when(F.col("label") == 0, CLASSES[0]).otherwise(CLASSES[1])
    text = F.concat(F.lit(PREAMBLE + "Which object is in cell number "), "cell", F.lit("?\n(A) "), a, F.lit("\n(B) "), b, F.lit("\nAnswer with the option's letter from the given choices directly."))
    return chosen.select("config", "img", text.alias("problem"), F.when(a == answer, "A").otherwise("B").alias("solution"), _bbox().alias("bbox"))


def outlier_queries(cells_: DataFrame) -> DataFrame:
    """Which cell is the outlier; raises where a grid has not exactly one."""
    fit = cells_.where((F.col("num_samples_class_0") == 1) & (F.col("grid_size") > 1))
    one = fit.groupBy("config", "img", "grid_size", "big_image_size").agg(F.count_if(F.col("label") == 0).alias("n"), F.min(F.when(F.col("label") == 0, F.col("cell"))).alias("cell"))
    cell = F.when(F.col("n") == 1, F.col("cell")).otherwise(F.raise_error(F.lit("expected exactly one outlier")).cast("int"))
    return one.withColumn("cell", cell).select("config", "img", F.lit(PREAMBLE + OUTLIER).alias("problem"), F.col("cell").cast("string").alias("solution"), _bbox().alias("bbox"))


def _bbox() -> Column:
    return G.cell_box(F.col("cell"), F.col("grid_size"), F.floor(F.col("big_image_size") / F.col("grid_size")).cast("int"))


def candidates(rows: DataFrame, key: str, ref: str, width: str, height: str, target: float, tries: int, seed: int = 0, min_side: int = MIN_SIDE) -> DataFrame:
    """``tries`` candidate boxes a row that aim at an IoU of ``target`` with the reference box.

    For a target of 0 boxes float freely (sides of ``min_side`` pixels to 60 %
    of the image); else the size is drawn around the reference, the overlap's width is
    drawn, its height solved, and the box laid to a drawn side.
    """
    tried = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    return _proposed(tried, key, ref, width, height, target, seed, min_side).where("cand is not null")


def _proposed(tried: DataFrame, key: str, ref: str, width: str, height: str, target: float, seed: int, min_side: int) -> DataFrame:
    """The candidate of each row's ``attempt``, NULL where it is rejected."""
    r = F.col(ref)
    w, h = F.col(width), F.col(height)
    u = lambda name: draw(f"{seed}{name}", key, "attempt")
    if target == 0:
        least = lambda size: F.greatest(F.lit(2), F.least(F.lit(min_side), size))
        side = lambda size, d: (least(size) + F.floor(d * (F.greatest(least(size), (size * 0.6).cast("int")) - least(size) + 1))).cast("int")
        tried = tried.withColumn("_w", side(w, u("w"))).withColumn("_h", side(h, u("h")))
        x, y = F.floor(u("x") * (w - F.col("_w") + 1)).cast("int"), F.floor(u("y") * (h - F.col("_h") + 1)).cast("int")
        return tried.withColumn("cand", G.box(x, y, x + F.col("_w"), y + F.col("_h"))).drop("_w", "_h")
    normal = lambda a, b: F.sqrt(-2 * F.log(F.greatest(u(a), F.lit(1e-12)))) * F.cos(2 * F.pi() * u(b))
    w1, h1 = r["x2"] - r["x1"], r["y2"] - r["y1"]
    a1 = (w1 * h1).cast("double")
    area = F.least(F.greatest(F.lit(1.0), F.bround(a1 * F.exp(normal("a", "b") * (0.9 * (1 - target) + 0.08)), 0)), w * h.cast("double"))
    aspect = F.exp(normal("c", "d") * 0.55)
    side = lambda v, size: F.greatest(F.lit(2), F.least(size, F.bround(F.sqrt(v), 0).cast("int")))
    sized = tried.withColumn("_w", side(area * aspect, w)).withColumn("_h", side(area / aspect, h))
    w2, h2 = F.col("_w"), F.col("_h")
    both = F.least(a1, (w2 * h2).cast("double"))
    need = F.greatest(F.lit(0.0), F.least(both, F.lit(target) * (a1 + w2 * h2) / (1 + target)))
    sized = sized.withColumn("_ow", F.greatest(F.lit(1), F.bround((0.15 + 0.85 * u("o")) * F.least(w1, w2), 0).cast("int"))).withColumn("_oh", F.bround(need / F.col("_ow"), 0).cast("int"))
    apart = lambda a, b, o, d: F.greatest(F.lit(0), F.bround((a + b) / 2 - o, 0).cast("int")) * F.when(u(d) < 0.5, -1).otherwise(1)
    x = F.bround((r["x1"] + r["x2"]) / 2 + apart(w1, w2, F.col("_ow"), "e") - w2 / 2, 0).cast("int")
    y = F.bround((r["y1"] + r["y2"]) / 2 + apart(h1, h2, F.col("_oh"), "f") - h2 / 2, 0).cast("int")
    laid = sized.withColumn("cand", G.box(x, y, x + w2, y + h2))
    fits = (F.col("_oh") >= 1) & (F.col("_oh") <= F.least(h1, h2))
    inside = (F.col("cand.x1") >= 0) & (F.col("cand.y1") >= 0) & (F.col("cand.x2") <= w) & (F.col("cand.y2") <= h)
    return laid.withColumn("cand", F.when(fits & inside, F.col("cand"))).drop("_w", "_h", "_ow", "_oh")


def negative_boxes(
    rows: DataFrame, key: str, ref: str, width: str, height: str, target: float, tolerance: float = 0.05, tries: int = 8, seed: int = 0, others: str | None = None, threshold: float = 0.05, max_tries: int = 5000, min_side: int = MIN_SIDE
) -> DataFrame:
    """The best candidate of each row: first one within tolerance, else the nearest to the target.

    Candidates with an IoU over ``threshold`` to one of the boxes in the array
    column ``others`` count as outside the tolerance. A target of -1 gives the
    reference box itself; a row without any candidate has a NULL box. Digits of
    the new coordinates must be as many as those of the old ones wherever some
    candidate within tolerance allows it. Rows without such a candidate among
    the first ``tries`` go on up to ``max_tries``: the result is the same as that
    of all tries at once, whatever ``tries`` is. Keys are unique. Rows are dealt
    out by key, and a task tries whole vectors of its open rows (``tries.best``).

    At a target of 0 only boxes that do not overlap the reference box are within
    tolerance, and no side is below ``min_side`` pixels. Beside a reference box
    that is the whole image there is no room: it gets a box of ``min_side``.
    """
    if target == -1:
        return rows.select(key, F.col(ref).alias("bbox"), F.lit(0.0).alias("error"))
    if target == 0:
        r = F.col(ref)
        whole = F.coalesce((r["x1"] <= 0) & (r["y1"] <= 0) & (r["x2"] >= F.col(width)) & (r["y2"] >= F.col(height)), F.lit(False))
        least = F.struct(*(F.least(F.lit(min_side), F.col(c)) for c in (width, height)))
        u = lambda name: draw(f"{seed}{name}", key, "attempt")
        corner = rows.where(whole).withColumn("attempt", F.lit(0)).withColumn("_s", least)
        x, y = F.floor(u("x") * (F.col(width) - F.col("_s.col1") + 1)).cast("int"), F.floor(u("y") * (F.col(height) - F.col("_s.col2") + 1)).cast("int")
        corner = corner.withColumn("cand", G.box(x, y, x + F.col("_s.col1"), y + F.col("_s.col2"))).select(key, F.col("cand").alias("bbox"), G.overlap_int(F.col(ref), F.col("cand")).alias("error"))
        rows, tolerance = rows.where(~whole), 0.0
    corners = ("x1", "y1", "x2", "y2")
    flat = lambda o: F.array(*(o[c].cast("long") for c in corners))
    near = F.flatten(F.transform(F.filter(others, lambda o: ~F.exists(flat(o), lambda v: v.isNull())), flat)) if others else F.lit(None)
    near = F.coalesce(near, F.array().cast("array<long>")).alias("others")
    sized = rows.select(F.col(key).alias("key"), F.col(key).cast("string").alias("text"), *(F.col(ref)[c].cast("long").alias(c) for c in corners), F.col(width).cast("long").alias("w"), F.col(height).cast("long").alias("h"), near)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number stays: the rows are few, their candidates many
    result = T.StructType([T.StructField("key", rows.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in corners), T.StructField("error", T.DoubleType())])
    run = tries_of.runner(target, tolerance, threshold, seed, min_side, max_tries)
    bbox = F.when(F.col("x1").isNotNull(), G.box(*(F.col(c) for c in corners)).cast(rows.schema[ref].dataType))
    out = sized.repartition(parts, "key").mapInArrow(run, result).select(F.col("key").alias(key), bbox.alias("bbox"), "error")
    return out if target else out.unionByName(corner)
