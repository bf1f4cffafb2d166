"""Group-relative policy operators: rewards, advantages, losses, samplers and the replay buffer.

Groups are named by an explicit column; nothing relies on physical row order.
Draws are made from md5 of a seed and the row's key, so they are the same on
every engine, attempt and partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.numbering import numbered
from tessera.operators.pinned import pin

EPSILON = 1e-4


def draw(seed: int | str, *keys: str) -> Column:
    """A number in [0, 1) from the seed and the keys: 13 hexadecimal digits of md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


# Rewards -----------------------------------------------------------------


def conditional(reward: Column, accuracy: Column, threshold: float = 0.5) -> Column:
    """The reward where the answer is right, else 0."""
    return F.when(accuracy > threshold, reward).otherwise(0.0)


def weighted(rewards: dict[str, Column], weights: dict[str, float], usage: dict[str, str] | None = None, part: str = "reward") -> Column:
    """Weighted sum, by name, of the rewards used for ``part`` (``reward`` or ``sampling_weights``); NULL counts as 0."""
    total = F.lit(0.0)
    for name, column in rewards.items():
        if (usage or {}).get(name, "both") in ("both", part):
            total = total + F.coalesce(column, F.lit(0.0)) * F.lit(float(weights[name]))
    return total


class Rewards:
    """Reward functions by name.

    A function takes the data's columns (by name, whatever the dataset has) and
    its own settings, and gives a Column, of one row or over a window of the
    group; None counts as zeros.
    """

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., Column | None]] = {}

    def register(self, name: str, reward: Callable[..., Column | None]) -> None:
        if name in self._known:
            raise ValueError(f"reward {name!r} is registered twice")
        self._known[name] = reward

    def columns(self, rows: DataFrame, names: list[str], **settings: object) -> dict[str, Column]:
        """One Column for each name, unknown names raise."""
        data = {c: F.col(f"`{c}`") for c in rows.columns}
        out = {}
        for name in names:
            if name not in self._known:
                raise KeyError(f"unknown reward {name!r}; known are {sorted(self._known)}")
            made = self._known[name](data, **settings)
            out[name] = F.lit(0.0) if made is None else made.cast("double")
        return out


def process_slice(rows: DataFrame, position: str, rank: int, size: int) -> DataFrame:
    """The rows of a gathered vector that belong to one process: ``size`` places from rank * size on."""
    return rows.where((F.col(position) >= rank * size) & (F.col(position) < (rank + 1) * size))


def pick_gold(solutions: Column, seed: int, *keys: str) -> Column:
    """One of the gold answers, drawn by key."""
    return F.get(solutions, F.floor(draw(seed, *keys) * F.size(solutions)).cast("int"))


def curiosity(uses: str, group: str, threshold: float) -> Column:
    """What the group's share of tool use falls short of ``threshold``, for rows that use the tool."""
    used = (F.col(uses) > 0).cast("double")
    rate = F.avg(used).over(Window.partitionBy(group))
    return F.greatest(F.lit(threshold) - rate, F.lit(0.0)) * used


def penalty(uses: Column, threshold: int) -> Column:
    return F.least(F.lit(threshold) - uses, F.lit(0))


def constant_exploration(uses: Column) -> Column:
    return (uses > 0).cast("double")


def advantage(reward: Column, group: str) -> Column:
    """(r - mean) / (sample deviation + 1e-4) in the group; NULL in a group of one."""
    w = Window.partitionBy(group)
    return (reward - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + EPSILON)


def sampling_weight(reward: Column, group: str) -> Column:
    return F.abs(advantage(reward, group))


# Losses ------------------------------------------------------------------


def log_softmax(logits: Column, index: Column) -> Column:
    """Log probability of the indexed (0-based) logit."""
    top = F.array_max(logits)
    return F.get(logits, index) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def entropy(logits: Column) -> Column:
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.log(z) - F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top) * (x - top)) / z


def token_loss(lp: Column, old: Column, ref: Column, adv: Column, clip: float = 0.2, beta: float = 0.04) -> dict[str, Column]:
    """Clipped surrogate with a k3 divergence penalty, per token: loss, divergence, and whether it was clipped."""
    ratio = F.exp(lp - old)
    held = F.greatest(F.lit(1 - clip), F.least(ratio, F.lit(1 + clip)))
    raw = F.exp(ref - lp) - (ref - lp) - 1
    kl = F.when(F.isnan(raw) | (F.abs(raw) == float("inf")), 0.0).otherwise(raw)
    return {"loss": -F.least(ratio * adv, held * adv) + F.lit(beta) * kl, "kl": kl, "clipped": (ratio * adv > held * adv).cast("double")}


def grpo_loss(tokens: DataFrame, row: str, mask: str = "mask", clip: float = 0.2, beta: float = 0.04) -> DataFrame:
    """Masked mean per row, then mean over rows, of token loss, divergence and clip share."""
    parts = token_loss(F.col("lp"), F.col("old"), F.col("ref"), F.col("adv"), clip, beta)
    rows = tokens.groupBy(row).agg(*(F.try_divide(F.sum(F.col(mask) * c), F.sum(mask)).alias(n) for n, c in parts.items()))
    return rows.agg(*(F.avg(n).alias(n) for n in parts))


def override_span(advantage_: Column, mask: Column, value: Column, start: Column, end: Column) -> Column:
    """The row's advantage for each token, with ``value`` on [start, end)."""
    return F.transform(mask, lambda _, i: F.when(value.isNotNull() & (i >= start) & (i < end), value).otherwise(advantage_))


def shift_mask(mask: Column) -> Column:
    """The mask without its first token, as log-probs are one shorter than ids."""
    return F.slice(mask, 2, F.greatest(F.size(mask) - 1, F.lit(0)))


# Contrast ----------------------------------------------------------------


def logaddexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def infonce(pos: Column, negs: list[Column], strict: bool = False) -> Column:
    """Per token: logaddexp(pos, pos) against logaddexp(pos, neg), further negatives joining both sides.

    A NULL negative array is left out, or makes the result NULL when strict.
    """
    missing = F.lit(False)
    for n in negs:
        missing = missing | n.isNull()
    zipped = F.arrays_zip(pos.alias("p"), *(F.coalesce(n, F.array_repeat(F.lit(None).cast("double"), F.size(pos))).alias(f"n{i}") for i, n in enumerate(negs)))

    def score(t: Column) -> Column:
        top = below = None
        p = t["p"]
        top = logaddexp(p, p)
        below = F.when(t["n0"].isNull(), top).otherwise(logaddexp(p, t["n0"]))
        for i in range(1, len(negs)):
            n = t[f"n{i}"]
            top, below = F.when(n.isNull(), top).otherwise(logaddexp(top, n)), F.when(n.isNull(), below).otherwise(logaddexp(below, n))
        return top - below

    out = F.transform(zipped, score)
    return F.when(~missing, out) if strict else out


def contrast_reward(diff: Column, *, delta: float | None = None, gamma: float | None = None, tau: float = 0.0, alpha: float = 1.0, length_factor: float | str = 1.0, scaling: float = 1.0, q: float | None = None, discretize: bool = False, tanh: bool = False, select_k: int | None = None, select: str | None = None) -> Column:
    """Reward of a row's token differences: share above ``delta``, ``q``-quantile, or clipped sum. NULL and empty give 0."""
    if select_k is not None and select is not None:
        if select not in ("first", "max"):
            raise ValueError(f"unknown selection: {select}")
        diff = F.slice(diff, 1, select_k) if select == "first" else F.slice(F.reverse(F.array_sort(diff)), 1, select_k)
    n = F.size(diff)
    factor = F.pow(F.try_divide(F.lit(float(scaling)), n), F.lit(float(alpha))) if length_factor == "len" else F.lit(float(length_factor) ** alpha)
    held = diff if gamma is None else F.transform(diff, lambda x: F.greatest(F.lit(-gamma), F.least(x, F.lit(gamma))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    if delta is not None:
        out = total(F.transform(diff, lambda x: (x > delta).cast("double") * factor)) / n
    elif q is not None:
        order = F.array_sort(F.transform(held, lambda x: x - tau))
        at = F.lit(q) * (n - 1)
        low = F.floor(at).cast("int")
        a, b = F.get(order, low), F.get(order, F.least(low + 1, n - 1))
        out = a + (b - a) * (at - low)
    else:
        out = factor * total(F.transform(held, lambda x: x - tau))
    if discretize:
        out = F.when(out < 0, -1.0).otherwise(1.0)
    if tanh:
        out = F.tanh(out)
    return F.when(diff.isNull() | (n == 0), 0.0).otherwise(out)


def curriculum(step: Column, start: float, end: float, most: float = 1.0, increase: str = "linear") -> Column:
    """Target by step: 0 before the start, 1 after the end, linear to ``most`` between."""
    if increase != "linear":
        return F.lit(None).cast("double")
    div = 1.0 if start == end else end - start
    return F.when(step < start, 0.0).when(step > end, 1.0).otherwise(F.lit(most) * (step - start) / F.lit(float(div)))


# Samplers ----------------------------------------------------------------


def repeat_sampler(rows: DataFrame, key: str, batch: int, repeat: int, mini_repeat: int = 1, seed: int | None = None) -> DataFrame:
    """Chunks of ``batch`` rows, whole chunks only, each emitted ``repeat`` times with each row ``mini_repeat`` times.

    Adds chunk, rep, pos and mini, whose order is the order of emission.
    """
    keyed = rows.withColumn("_draw", draw(seed, key)) if seed is not None else rows
    placed = numbered(keyed, *(["_draw"] if seed is not None else []), key).drop("_draw")
    total = placed.agg(F.max("rn").alias("_total"))
    chunked = placed.crossJoin(F.broadcast(total)).where(F.col("rn") <= F.floor(F.col("_total") / batch) * batch).withColumn("chunk", F.floor((F.col("rn") - 1) / batch)).withColumn("pos", (F.col("rn") - 1) % batch).drop("rn", "_total")
    return chunked.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("mini", F.explode(F.sequence(F.lit(0), F.lit(mini_repeat - 1))))


def repeat_rows(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def mini_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Fixed-order batches; the last one may be short."""
    return numbered(rows, key).withColumn("batch", F.floor((F.col("rn") - 1) / size)).drop("rn")


def row_range(rows: DataFrame, key: str, left: int, right: int) -> DataFrame:
    """Rows [left, right) in key order."""
    return numbered(rows, key).where((F.col("rn") > left) & (F.col("rn") <= right)).drop("rn")


def dedup_prompts(rows: DataFrame, group: str, position: str) -> DataFrame:
    """The first row of each group of repeats."""
    return rows.where(F.col(position) == 0).dropDuplicates([group])


def split(rows: DataFrame, key: str, test_share: float, seed: int = 0) -> DataFrame:
    """Adds ``part``: train or validation, by a draw from the key."""
    return rows.withColumn("part", F.when(draw(seed, key) < test_share, "validation").otherwise("train"))


def _cut(rows: DataFrame, column: str, k: int, last: bool) -> tuple[DataFrame, int]:
    """Rows that surely hold the ``k`` first (or last) by a number column, few more than these, and how many rows there are in all.

    A quantile sketch gives the cut; where it proves too tight, or the column
    is no number, all rows stay.
    """
    n = rows.count()
    if k >= n or not isinstance(rows.schema[column].dataType, T.NumericType):
        return rows, n
    share = k / n
    at = F.percentile_approx(column, F.lit(max(0.0, 1 - share - 0.002) if last else min(1.0, share + 0.002)), F.lit(2000))
    bound = rows.agg(at.alias("_bound")).first()[0]
    kept = rows.where(F.col(column) >= bound if last else F.col(column) <= bound)
    return (kept if kept.count() >= k else rows), n


def weighted_sample(rows: DataFrame, key: str, weight: str, k: int, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """k rows without replacement, weight**alpha each; all-zero weights draw uniformly.

    Exponential keys: the k least of -ln(u) / w. A quantile sketch cuts off
    nearly all others, and what is left is ranked over range partitions: no
    task holds k rows.
    """
    powered = rows.withColumn("_w", F.when(F.col(weight) > 0, F.pow(F.col(weight), F.lit(alpha))).otherwise(0.0))
    any_weight = powered.agg((F.coalesce(F.max("_w"), F.lit(0.0)) > 0).alias("_any"))
    keyed = powered.crossJoin(F.broadcast(any_weight)).withColumn("_w", F.when(F.col("_any"), F.col("_w")).otherwise(1.0)).where("_w > 0")
    drawn = keyed.withColumn("_key", -F.log(F.greatest(draw(seed, key), F.lit(1e-15))) / F.col("_w")).drop("_w", "_any")
    few, _ = _cut(drawn, "_key", k, False)
    return numbered(few, "_key", key).where(F.col("rn") <= k).drop("rn", "_key")


def weighted_draws(rows: DataFrame, key: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """k draws with replacement: each draw finds its row in the running sum of weights.

    Draws and rows are laid on one line, rows where their weight starts, and
    range-partitioned by place; a draw takes the last row before it, from the
    partition before where its own holds none. So neither the draws nor the
    rows of a partition are paired with each other.
    """
    clean = rows.where(F.col(weight) > 0).select(F.struct(*rows.columns).alias("_row"), F.col(key).alias("_k"), F.col(weight).cast("double").alias("_w"))
    ranged = pin(clean.repartitionByRange("_k").withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_in", F.sum("_w").over(Window.partitionBy("_part").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)))
    parts = ranged.groupBy("_part").agg(F.sum("_w").alias("_sum")).withColumn("_end", F.sum("_sum").over(Window.orderBy("_part")))
    starts = inside.join(F.broadcast(parts), "_part").select((F.col("_end") - F.col("_sum") + F.col("_in") - F.col("_w")).alias("_at"), "_row", F.lit(None).cast("long").alias("draw"))
    draws = rows.sparkSession.range(k).select(F.col("id").alias("draw"), draw(seed, "id").alias("_u"))
    placed = draws.crossJoin(F.broadcast(parts.agg(F.max("_end").alias("_total")))).select((F.col("_u") * F.col("_total")).alias("_at"), F.lit(None).cast(starts.schema["_row"].dataType).alias("_row"), "draw")
    line = pin(starts.unionByName(placed).repartitionByRange("_at").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part").orderBy("_at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    lasts = line.where("draw is null").groupBy("_part").agg(F.max_by("_row", "_at").alias("_last"))
    carried = line.select("_part").distinct().join(lasts, "_part", "left").withColumn("_carried", F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    found = line.withColumn("_here", F.last("_row", ignorenulls=True).over(before)).where("draw is not null").join(F.broadcast(carried), "_part")
    return found.select("draw", F.coalesce("_here", "_carried").alias("_row")).select("draw", "_row.*")


# Replay buffer -----------------------------------------------------------


def ring_buffer(rows: DataFrame, order: str, capacity: int) -> DataFrame:
    """What a ring of ``capacity`` slots holds after all writes: the last row of each slot.

    Row n goes to slot (n - 1) % capacity. The last ``capacity`` rows are cut
    off by a quantile sketch and numbered over range partitions: no task holds
    all of them. Values of ``order`` are distinct and not null.
    """
    few, n = _cut(rows, order, capacity, True)
    before = n - few.count()
    placed = numbered(few, order).withColumn("rn", F.col("rn") + before)
    return placed.where(F.col("rn") > n - capacity).withColumn("slot", (F.col("rn") - 1) % capacity).drop("rn")


def sync_buffers(buffers: DataFrame, rank: str, slot: str, begin: int, end: int, capacity: int) -> DataFrame:
    """Slots [begin, end) of every rank's buffer at their place in the global one, rank * capacity + slot; raises where ranks differ in number."""
    if not 0 <= begin < end <= capacity:
        raise ValueError("begin must be smaller than end, and both inside the buffer")
    taken = buffers.where((F.col(slot) >= begin) & (F.col(slot) < end))
    full = taken.groupBy(rank).agg((F.count("*") == end - begin).alias("_full"))
    checked = taken.join(full, rank)
    place = F.when(F.col("_full"), F.col(rank) * capacity + F.col(slot)).otherwise(F.raise_error(F.lit("the buffers are filled unequally")).cast("bigint"))
    return checked.withColumn("global_slot", place).drop("_full")


def generates(step: Column, every: int, held: Column) -> Column:
    """Whether a step makes new rollouts: each ``every``-th one, and any that finds the buffer empty."""
    return (step % every == 0) | (held == 0)


def buffer_read(buffer: DataFrame, start: int, size: int) -> DataFrame:
    """The next ``size`` slots from ``start``; a read does not wrap around."""
    return buffer.where((F.col("slot") >= start) & (F.col("slot") < start + size))
