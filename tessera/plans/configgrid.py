"""Evaluation plans: products of parameter lists, dataset unpacking, names and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short names of datasets.
SHORT = {"pixel_reasoner": "pr", "pixel_reasoner_vstar": "V*", "hr_bench_4k": "hrb_4k", "hr_bench_8k": "hrb_8k", "mme_lite": "mme_lite", "mme": "mme"}
GRID = "muffin_chihuahua"
DEFAULTS = {"batch_size": 200, "image_limit": 6, "max_tool_uses": 5, "max_tokens_per_reply": 256, "tool_padding": 0.1, "adaptive_padding_threshold": 600, "temperature": 0.0, "num_generations": 1, "max_pixels": 1024 * 16 * 28 * 28, "min_pixels": 4 * 28 * 28}


def product(spark: SparkSession, config: dict) -> DataFrame:
    """One row per combination of the lists of a configuration; scalars are lists of one."""
    out = spark.range(1).select()
    for name, value in config.items():
        values = value if isinstance(value, list) else [value]
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return out


def unpack_datasets(datasets: DataFrame) -> DataFrame:
    """name, path (and grid_pixels, gridsize, mode lists) as one row per dataset with its short name.

    The grid dataset becomes one row per grid size, pixels and mode, without
    outlier questions on single cells.
    """
    grid = datasets.where(F.col("name") == GRID).select("path", F.explode("gridsize").alias("g"), "grid_pixels", "mode").select("path", "g", F.explode("grid_pixels").alias("k"), "mode").select("path", "g", "k", F.explode("mode").alias("m"))
    grid = grid.where(~((F.col("g") == 1) & (F.col("m") == "find_outlier")))
    samples = F.when(F.col("m") == "single_cell_query", F.greatest(F.lit(1), F.floor(F.col("g") * F.col("g") / 2).cast("int"))).when(F.col("m") == "find_outlier", 1).otherwise(F.raise_error(F.concat(F.lit("Unknown mode "), "m")).cast("int"))
    name = F.concat(F.lit(f"{GRID}_grid_pixels_"), F.col("k") * 1024, F.lit("_gridsize_"), "g", F.lit("_samples_class_0_"), samples)
    short = F.concat("k", F.lit("k_"), "g", F.when(F.col("m") == "single_cell_query", "_scq").otherwise("_fo"))
    plain = datasets.where(F.col("name") != GRID)
    return grid.select(name.alias("dataset_name"), short.alias("short"), F.col("path").alias("dataset_path")).unionByName(plain.select(F.col("name").alias("dataset_name"), short_name(F.col("name")).alias("short"), F.col("path").alias("dataset_path")))


def short_name(name: Column) -> Column:
    out = name
    for k, v in SHORT.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def eval_name(short: Column, dataset: Column, tool: Column, max_px: Column, min_px: Column, padding: Column, temperature: Column, num: Column) -> Column:
    base = [x.cast("string") for x in (short, dataset, tool, max_px, min_px, padding)]
    return F.when(temperature > 0, F.concat_ws("_", *base, temperature.cast("string"), num.cast("string"))).otherwise(F.concat_ws("_", *base))


def save_path(root: Column, suffix: Column, dataset: Column, tool: Column, max_px: Column, min_px: Column, padding: Column, temperature: Column, num: Column, legacy: bool = False) -> Column:
    head = F.concat(root, F.lit("/"), suffix, F.lit("/dataset_"), dataset, F.lit("_prompt_"), tool, F.lit("_max_pixels_"), max_px.cast("string"), F.lit("_min_pixels_"), min_px.cast("string"))
    if legacy:
        return head
    padded = F.concat(head, F.lit("_padding_"), padding.cast("string"))
    return F.when(temperature > 0, F.concat(padded, F.lit("_temp_"), temperature.cast("string"), F.lit("_samples_"), num.cast("string"))).otherwise(padded)


def dataset_params(name: Column, path: Column) -> Column:
    """(task, data_files, image_folders) from a dataset's name and path."""
    grid = name.startswith(GRID)
    task = F.when(name.endswith("class_0_1") & ~name.contains("gridsize_1_"), "find_outlier").otherwise("single_cell_query")
    sub = F.concat(path, F.lit("/"), F.regexp_replace(name, f"^{GRID}_", ""))
    return F.struct(F.when(grid, task).alias("task"), F.when(grid, F.concat(sub, F.lit("/"), task, F.lit(".jsonl"))).otherwise(F.concat(path, F.lit("/test.jsonl"))).alias("data_files"), F.when(grid, F.concat(sub, F.lit("/images"))).otherwise(path).alias("image_folders"))


def choose(evals: DataFrame, name: str, names: list[str] | None, fixed: dict | None = None) -> DataFrame:
    """Evaluations with one of the names (all without names) whose parameters equal all fixed ones."""
    out = evals if names is None else evals.where(F.col(name).isin(names))
    for key, value in (fixed or {}).items() if names is not None else ():
        out = out.where(F.col(key).eqNullSafe(F.lit(value))) if key in evals.columns else out.where(F.lit(False))
    return out


def in_order(evals: DataFrame, name: str, names: list[str]) -> DataFrame:
    """The named evaluations with ``pos``, their place in the list."""
    spark = evals.sparkSession
    order = spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], f"`{name}` string, pos int")
    return evals.join(F.broadcast(order), name)


def zip_lists(rows: DataFrame, *lists: str) -> DataFrame:
    """Parallel lists as rows with their position; raises where their lengths differ."""
    same = F.lit(True)
    for c in lists[1:]:
        same = same & (F.size(c) == F.size(lists[0]))
    zipped = F.when(same, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit("the lists differ in length")).cast(f"array<struct<{','.join(f'{c}:{rows.schema[c].dataType.elementType.simpleString()}' for c in lists)}>>"))
    return rows.select(*(c for c in rows.columns if c not in lists), F.posexplode(zipped).alias("pos", "_z")).select(*(c for c in rows.columns if c not in lists), "pos", "_z.*")
