"""One training step as one pass: rewards and advantages are written, and the step's metrics are observed on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import policy as P


def score_step(rows: DataFrame, group: str, rewards: dict[str, Column], weights: dict[str, float], accuracy: str, uses: str, attempts: str, length: str, limit: int, path: str) -> dict[str, float | int | None]:
    """Write the rows with their rewards, ``reward`` and ``advantage`` to ``path``; the metrics of the step.

    The advantage is relative to the group, NULL in a
    group of one row. Metrics come from the job that writes, so the rows
    are read and scored once: mean of each reward, over all rows and over those
    that are not 0; deviation over groups of their mean tool uses; rate of tool
    calls that succeeded, -1 without any; the four cells of right and
    tool; mean length without NaN; rows of at least ``limit`` tokens; range and
    sum of the advantages. A step without rows has counts of 0 and NULL means.
    """
    scored = rows.select("*", *(c.cast("double").alias(f"reward_{n}") for n, c in rewards.items()))
    scored = scored.withColumn("reward", P.weighted({n: F.col(f"reward_{n}") for n in rewards}, weights))
    same = Window.partitionBy(group)
    made = scored.withColumns({"advantage": P.advantage(F.col("reward"), group), "_uses": F.avg(uses).over(same), "_size": F.count("*").over(same)})
    seen = Observation()
    cells = M.confusion(F.col(accuracy), F.col(uses))
    asked = {
        **{f"{n}_mean": F.avg(f"reward_{n}") for n in rewards},
        **{f"{n}_nonzero_mean": M.nonzero_mean(F.col(f"reward_{n}")) for n in rewards},
        **cells,
        "rows": F.count("*"),
        # Sums of one share a row are sums over groups.
        "_groups": F.sum(1 / F.col("_size")),
        "_sum": F.sum(F.col("_uses") / F.col("_size")),
        "_squares": F.sum(F.col("_uses") * F.col("_uses") / F.col("_size")),
        "tool_success_rate": M.tool_success(uses, attempts, -1.0),
        "length_mean": M.nanmean(F.col(length)),
        "truncated": F.count_if(F.col(length) >= limit),
        "advantage_min": F.min("advantage"),
        "advantage_max": F.max("advantage"),
        "advantage_sum": F.sum("advantage"),
    }
    made.observe(seen, *(c.alias(n) for n, c in asked.items())).drop("_uses", "_size").write.mode("overwrite").parquet(path)
    got = dict(seen.get)
    groups, total, squares = (got.pop(n) for n in ("_groups", "_sum", "_squares"))
    got["tool_group_std"] = max(0.0, squares / groups - (total / groups) ** 2) ** 0.5 if groups else None
    return got
