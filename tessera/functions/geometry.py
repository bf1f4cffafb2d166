"""Bounding-box geometry as Column expressions.

Boxes are structs (x1, y1, x2, y2); pairs are passed as such structs. All
divisions are guarded, so ANSI mode raises nothing but the errors asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Side multiple of resized images by base model, and default pixel bounds in squares of it.
FACTORS = {"qwen_2p5": 28, "qwen_3p5": 32}
LEAST_SQUARES = {"qwen_2p5": 4, "qwen_3p5": 64}
MOST_SQUARES = 16 * 1024
MIN_SIDE = 28


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a.cast("double"), b)).otherwise(F.lit(0.0))


def overlap(pred: Column, gold: Column) -> Column:
    """(iou, precision, recall); inverted intersections and zero areas give 0."""
    left, top = F.greatest(pred["x1"], gold["x1"]), F.greatest(pred["y1"], gold["y1"])
    right, bottom = F.least(pred["x2"], gold["x2"]), F.least(pred["y2"], gold["y2"])
    inter = F.when((right < left) | (bottom < top), 0).otherwise((right - left) * (bottom - top))
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    p, g = area(pred), area(gold)
    return F.struct(_ratio(inter, p + g - inter).alias("iou"), _ratio(inter, p).alias("precision"), _ratio(inter, g).alias("recall"))


def overlap_int(ref: Column, cand: Column, metric: str = "iou") -> Column:
    """IoU or recall of integer boxes; inverted boxes have no area."""
    if metric not in ("iou", "recall"):
        raise ValueError(f"unknown metric: {metric}")
    side = lambda lo, hi: F.greatest(F.lit(0), hi - lo)
    inter = side(F.greatest(ref["x1"], cand["x1"]), F.least(ref["x2"], cand["x2"])) * side(F.greatest(ref["y1"], cand["y1"]), F.least(ref["y2"], cand["y2"]))
    area = lambda b: side(b["x1"], b["x2"]) * side(b["y1"], b["y2"])
    return _ratio(inter, area(ref) + area(cand) - inter if metric == "iou" else area(ref))


def cell_box(cell: Column, per_row: Column, size: Column) -> Column:
    """Pixel box of a numbered grid cell."""
    col, row = cell % per_row, F.floor(F.try_divide(cell, per_row)).cast("int")
    return box(col * size, row * size, (col + 1) * size, (row + 1) * size)


def is_relative(b: Column) -> Column:
    return (b["x1"] < 1) & (b["y1"] < 1) & (b["x2"] < 1) & (b["y2"] < 1)


def mode(b: Column, bbox_type: str | None = None) -> Column:
    """``relative`` or ``absolute_resized``, as declared or by the values."""
    if bbox_type in ("relative", "absolute"):
        return F.lit("relative" if bbox_type == "relative" else "absolute_resized")
    return F.when(is_relative(b), "relative").otherwise("absolute_resized")


def effective_padding(padding: Column, width: Column, height: Column, threshold: float | None) -> Column:
    """Padding (x, y), bounded to ``threshold`` pixels of the input's size."""
    if threshold is None:
        return padding
    part = lambda p, size: F.least(p, F.try_divide(F.lit(float(threshold)), size))
    return F.struct(part(padding["x"], width).alias("x"), part(padding["y"], height).alias("y"))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(F.lit(0.0), x), F.lit(1.0))


def normalized(b: Column, padding: Column, width: Column, height: Column, bbox_type: str | None = None) -> Column:
    """The padded box in [0, 1]; raises where the values deny the declared type."""
    d = lambda c: c.cast("double")
    rel, absolute = (d(b["x1"]), d(b["y1"]), d(b["x2"]), d(b["y2"])), (F.try_divide(d(b["x1"]), width), F.try_divide(d(b["y1"]), height), F.try_divide(d(b["x2"]), width), F.try_divide(d(b["y2"]), height))
    if bbox_type == "relative":
        checked = F.when(is_relative(b), rel[0]).otherwise(F.raise_error(F.lit("bbox_type='relative' but bbox values are not < 1.")).cast("double"))
        raw = (checked, *rel[1:])
    elif bbox_type == "absolute":
        whole = F.lit(True)
        for v in rel:
            whole = whole & (v == F.floor(v))
        raw = (F.when(whole, absolute[0]).otherwise(F.raise_error(F.lit("bbox_type='absolute' but bbox values are not ints.")).cast("double")), *absolute[1:])
    else:
        raw = tuple(F.when(is_relative(b), r).otherwise(a) for r, a in zip(rel, absolute))
    return box(clamp01(raw[0] - padding["x"]), clamp01(raw[1] - padding["y"]), clamp01(raw[2] + padding["x"]), clamp01(raw[3] + padding["y"]))


def pixel_box(norm: Column, width: Column, height: Column) -> Column:
    """Pixels of a normalised box: truncated, inside the image, at least one pixel a side."""
    i = lambda v, size: (v * size).cast("int")
    low = lambda v, size: F.greatest(F.lit(0), F.least(i(v, size), size - 1))
    high = lambda v, size: F.greatest(F.lit(1), F.least(i(v, size), size))
    past = lambda lo, hi, size: F.when(hi <= lo, F.least(size, lo + 1)).otherwise(hi)
    x1, y1 = low(norm["x1"], width), low(norm["y1"], height)
    return box(x1, y1, past(x1, high(norm["x2"], width), width), past(y1, high(norm["y2"], height), height))


def zoom_box(b: Column, padding: Column, input_w: Column, input_h: Column, width: Column, height: Column, threshold: float | None = None, bbox_type: str | None = None) -> Column:
    """Crop box on the original image; null where a side is not over 28 pixels."""
    norm = normalized(b, effective_padding(padding, input_w, input_h, threshold), input_w, input_h, bbox_type)
    cut = box((norm["x1"] * width).cast("int"), (norm["y1"] * height).cast("int"), (norm["x2"] * width).cast("int"), (norm["y2"] * height).cast("int"))
    return F.when((cut["x2"] - cut["x1"] > MIN_SIDE) & (cut["y2"] - cut["y1"] > MIN_SIDE), cut)


def smart_resize(height: Column, width: Column, base_model: str = "qwen_2p5", min_pixels: int | None = None, max_pixels: int | None = None) -> Column:
    """(w, h) as multiples of the model's factor within the pixel bounds; raises beyond an aspect ratio of 200."""
    if base_model not in FACTORS:
        raise NotImplementedError(base_model)
    f = FACTORS[base_model]
    least, most = min_pixels or LEAST_SQUARES[base_model] * f * f, max_pixels or MOST_SQUARES * f * f
    near = lambda v: F.greatest(F.lit(f), (F.bround(v / f, 0) * f).cast("int"))
    h, w = near(height), near(width)
    area = height.cast("double") * width
    shrink, grow = F.sqrt(area / F.lit(float(most))), F.sqrt(F.lit(float(least)) / area)
    down = lambda v: F.greatest(F.lit(f), (F.floor(v / shrink / f) * f).cast("int"))
    up = lambda v: (F.ceil(v * grow / f) * f).cast("int")
    size = h.cast("double") * w
    pick = lambda v, plain: F.when(size > most, down(v)).when(size < least, up(v)).otherwise(plain)
    sane = F.greatest(height, width) <= 200 * F.least(height, width)
    return F.when(sane, F.struct(pick(width, w).alias("w"), pick(height, h).alias("h"))).otherwise(F.raise_error(F.lit("absolute aspect ratio must be smaller than 200")).cast("struct<w:int,h:int>"))


def min_side(width: Column, height: Column, least: int = MIN_SIDE) -> Column:
    """(w, h) with the shorter side raised to ``least``, the other scaled and truncated."""
    scale = F.try_divide(F.lit(float(least)), F.least(width, height))
    small = F.least(width, height) < least
    grown = lambda a, b: F.when(small, F.when(a <= b, F.lit(least)).otherwise((a * scale).cast("int"))).otherwise(a)
    return F.struct(grown(width, height).alias("w"), grown(height, width).alias("h"))


def invert_padding(norm: Column, padding: Column) -> Column:
    """The box whose padding gives ``norm``, as far as there is one."""
    x1, y1 = clamp01(norm["x1"] + padding["x"]), clamp01(norm["y1"] + padding["y"])
    x2, y2 = clamp01(norm["x2"] - padding["x"]), clamp01(norm["y2"] - padding["y"])
    past = lambda lo, hi: F.when(hi <= lo, F.least(F.lit(1.0), lo + 1e-6)).otherwise(hi)
    return box(x1, y1, past(x1, x2), past(y1, y2))


def emit(norm: Column, width: Column, height: Column) -> Column:
    """A normalised box as absolute integers, half to even, inside the image."""
    r = lambda v, size: F.bround(clamp01(v) * size, 0).cast("int")
    x1, y1, x2, y2 = r(norm["x1"], width), r(norm["y1"], height), r(norm["x2"], width), r(norm["y2"], height)
    x2, y2 = F.when(x2 <= x1, x1 + 1).otherwise(x2), F.when(y2 <= y1, y1 + 1).otherwise(y2)
    low = lambda v, size: F.greatest(F.lit(0), F.least(v, size - 1))
    high = lambda v, size: F.greatest(F.lit(1), F.least(v, size))
    return box(low(x1, width), low(y1, height), high(x2, width), high(y2, height))


def shift(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def rotation_safe_side(side: Column, degrees: Column) -> Column:
    """Side of the square that a rotation by up to ``degrees`` keeps inside one of ``side``."""
    phi = F.radians(F.abs(degrees))
    return side / (F.sin(phi) + F.cos(phi))
