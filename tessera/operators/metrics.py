"""Result-table and training metrics as aggregate Columns.

Each metric is a builder of one aggregate over evaluation rows, so any number
of them runs in one ``agg`` pass over a group. Means of nothing are NULL unless
a default is part of the metric's definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.numbering import running

#: Tool uses are counted in bins 0..31.
TOOL_BINS = 32


def percent(x: Column, digits: int = 4) -> Column:
    """Rounded half to even, then times 100."""
    return F.bround(x, digits) * 100


def accuracy(acc: str = "accuracy") -> Column:
    return F.avg(acc) * 100


def accuracy_at(k: int, acc: str = "accuracy", uses: str = "tool_use") -> Column:
    """Rows with more than k uses count as wrong."""
    return F.avg(F.when(F.col(uses) <= k, F.col(acc)).otherwise(0.0)) * 100


def avg_tool_use(uses: str = "tool_use") -> Column:
    return F.avg(uses)


def area(size: Column) -> Column:
    return size["w"].cast("double") * size["h"]


def image_size(how: str, sizes: str = "image_sizes") -> Column:
    """avg, max, min or median of the first image's area."""
    first = area(F.get(sizes, 0))
    if how == "median":
        return F.percentile(first, F.lit(0.5))
    return {"avg": F.avg, "max": F.max, "min": F.min}[how](first)


def zoom_fraction(how: str, sizes: str = "image_sizes") -> Column:
    """Second image's share of the first one's area, where there are two."""
    share = F.when(F.size(sizes) > 1, F.try_divide(area(F.get(sizes, 1)), area(F.get(sizes, 0))))
    return F.avg(share) if how == "avg" else F.percentile(share, F.lit(0.5))


def overlap_first(metric: str) -> Column:
    """Mean over the first tool call of each sample, 0 where there is none."""
    return F.coalesce(percent(F.avg(F.when(F.col("call_idx") == 0, F.col(metric)))), F.lit(0.0))


def overlap_std(metric: str) -> Column:
    return F.stddev_pop(F.when(F.col("call_idx") == 0, F.col(metric)))


def completion_len(which: str, lens: str = "completion_len") -> Column:
    """total, first or second: mean completion length; second only where there is one."""
    if which == "total":
        return F.avg(F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x))
    if which == "first":
        return F.avg(F.get(lens, 0))
    return F.avg(F.when(F.size(lens) > 1, F.get(lens, 1)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r, NULL without variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def accuracy_if(used: bool, acc: str = "accuracy", uses: str = "tool_use") -> Column:
    return F.avg(F.when(F.col(uses) > 0 if used else F.col(uses) == 0, F.col(acc)))


def tool_success(uses: str = "tool_use", attempts: str = "attempted_tool_use", default: float | None = None) -> Column:
    rate = F.avg(F.when(F.col(attempts) != 0, F.try_divide(F.col(uses).cast("double"), F.col(attempts))))
    return rate if default is None else F.coalesce(rate, F.lit(default))


#: Every per-row metric by its column name in the results table.
REGISTRY: dict[str, Callable[[], Column]] = {
    "accuracy": accuracy,
    "accuracy@1": lambda: accuracy_at(1),
    "accuracy@2": lambda: accuracy_at(2),
    "accuracy@3": lambda: accuracy_at(3),
    "avg_pixel_reasoning": avg_tool_use,
    "avg_image_size": lambda: image_size("avg"),
    "max_image_size": lambda: image_size("max"),
    "min_image_size": lambda: image_size("min"),
    "median_image_size": lambda: image_size("median"),
    "zoom_in_fraction_avg": lambda: zoom_fraction("avg"),
    "zoom_in_fraction_median": lambda: zoom_fraction("median"),
    "avg_total_completion_len": lambda: completion_len("total"),
    "avg_first_completion_len": lambda: completion_len("first"),
    "avg_second_completion_len": lambda: completion_len("second"),
    "image_size_x_performance_correlation": lambda: correlation(area(F.get("image_sizes", 0)), F.col("accuracy")),
    "accuracy_if_tool_used": lambda: accuracy_if(True),
    "accuracy_if_tool_not_used": lambda: accuracy_if(False),
    "tool_success_rate": tool_success,
}
_NEEDS = {"accuracy": ("accuracy",), "tool": ("tool_use",), "pixel": ("tool_use",), "image": ("image_sizes",), "zoom": ("image_sizes",), "completion": ("completion_len",), "success": ("tool_use", "attempted_tool_use")}


def results(rows: DataFrame, metrics: list[str], by: str = "eval") -> DataFrame:
    """The chosen metrics per evaluation, in the given order; unknown ones, and those without their inputs, are NULL."""

    def one(name: str) -> Column:
        needs = {c for key, cs in _NEEDS.items() if key in name for c in cs}
        known = name in REGISTRY and needs <= set(rows.columns)
        return (REGISTRY[name]() if known else F.first(F.lit(None).cast("double"))).alias(name)

    return rows.groupBy(by).agg(*(one(m) for m in metrics))


def results_table(evals: DataFrame, measured: DataFrame, metrics: list[str], by: str = "eval") -> DataFrame:
    """Every evaluation with its metrics, missing ones NULL, columns in order."""
    return evals.join(measured, by, "left").select(*evals.columns, *(F.col(f"`{m}`") for m in metrics))


def tool_histogram(rows: DataFrame, by: str = "eval", uses: str = "tool_use", bins: int = TOOL_BINS) -> DataFrame:
    """Share of rows per number of uses over fixed bins, in percent; empty bins are 0."""
    counts = rows.where(F.col(uses).between(0, bins - 1)).groupBy(by, F.col(uses).alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(by).agg(F.sum("n").alias("total"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [by, "bin"], "left").select(by, "bin", percent(F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def overlap_by_call(calls: DataFrame, metric: str, by: str = "eval") -> DataFrame:
    """Mean per call index, joined by ``;`` in call order."""
    means = calls.groupBy(by, "call_idx").agg(percent(F.avg(metric)).alias("m"))
    return means.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_idx", "m"))), lambda s: F.format_string("%.2f", s["m"])), ";").alias(f"{metric}_distr"))


def overlap_last(calls: DataFrame, metric: str, by: str = "eval") -> DataFrame:
    """Mean over the last tool call of each sample."""
    last = calls.groupBy(by, "sample_id").agg(F.max(F.struct("call_idx", metric))[metric].alias("last"))
    return last.groupBy(by).agg(F.coalesce(percent(F.avg("last")), F.lit(0.0)).alias(f"{metric}_last"))


def group_tool_spread(rows: DataFrame, by: str, uses: str = "tool_use") -> Column | DataFrame:
    """Population deviation over groups of the groups' mean tool uses."""
    return rows.groupBy(by).agg(F.avg(uses).alias("m")).agg(F.stddev_pop("m").alias("tool_group_std"))


def nanmean(x: Column) -> Column:
    """Mean that skips NaN as well as NULL."""
    return F.avg(F.nanvl(x.cast("double"), F.lit(None).cast("double")))


def nonzero_mean(x: Column) -> Column:
    """Mean over values other than 0, -1 when there are none."""
    return F.coalesce(F.avg(F.nullif(x.cast("double"), F.lit(0.0))), F.lit(-1.0))


def confusion(acc: Column, uses: Column, threshold: float = 0.5) -> dict[str, Column]:
    """Counts of correct/wrong with/without a tool."""
    right, tool = acc > threshold, uses > 0
    return {"correct_tool": F.count_if(right & tool), "correct_no_tool": F.count_if(right & ~tool), "wrong_tool": F.count_if(~right & tool), "wrong_no_tool": F.count_if(~right & ~tool)}


def truncated(ids: str, limit: int) -> Column:
    return F.count_if(F.size(ids) >= limit)


def spread(x: Column) -> dict[str, Column]:
    """Mean, max, min, sum and the nine deciles (linear)."""
    out = {"mean": F.avg(x), "max": F.max(x), "min": F.min(x), "sum": F.sum(x)}
    return out | {f"q{i}": F.percentile(x, F.lit(i / 10)) for i in range(1, 10)}


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Rank correlation per group; ties share their average rank, NaN and NULL rows are left out.

    Rows are counted by value first, and the values' running counts come from
    range partitions, so neither a frequent value nor a large group is sorted
    in one task.
    """
    clean = rows.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y})").select(by, x, y)

    def ranks(c: str, name: str) -> DataFrame:
        counts = running(clean.groupBy(by, c).agg(F.count("*").alias("_n")), "_n", by, c)
        first = counts.groupBy(by).agg(F.min(F.col("_upto") - F.col("_n")).alias("_base"))
        rank = F.col("_upto") - F.col("_n") - F.col("_base") + (F.col("_n") + 1) / 2
        return counts.join(first, by).select(by, c, rank.alias(name))

    ranked = clean.join(ranks(x, "rx"), [by, x]).join(ranks(y, "ry"), [by, y])
    return ranked.groupBy(by).agg(correlation(F.col("rx"), F.col("ry")).alias("rho"))


def nonfinite(x: Column) -> Column:
    """NaN and infinite values."""
    return F.count_if(F.isnan(x) | (F.abs(x) == float("inf")))


def any_all_zero(mask: str) -> Column:
    """Whether some row's mask has no 1."""
    return F.bool_or(F.aggregate(mask, F.lit(0), lambda a, v: a + v) == 0)


def the_only(values: Column, what: str) -> Column:
    """The value that all rows of a group share; raises where they differ."""
    one = F.count_distinct(values) == 1
    return F.when(one, F.first(values)).otherwise(F.raise_error(F.lit(f"rows disagree on the {what}; name the one that is meant")))
