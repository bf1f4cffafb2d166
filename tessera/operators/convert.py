"""Converters of raw question-answer tables to canonical records, and prompt construction."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Instructions and prompt templates.
LETTER = "Answer with the option's letter from the given choices directly."
LETTER_IF = "If there are choices given, answer with the option's letter from the given choices directly."
_THINK = "First output the thinking process in <think> </think> tags and then output the final answer in <answer> </answer> tags."
_PR = "Guidelines: Understand the given visual information and the user query. Determine if it is beneficial to employ the given visual operations (tools)."
_BOXED = "Reason with the visual information step by step, and put your final answer within \\boxed{}."
TEMPLATES = {
    "rec": "{Question} \n " + _THINK + " Output the final answer in JSON format.",
    "no_think": "{Question} \n First output the thinking process and then output the final answer in <answer> </answer> tags.",
    "no_think_tool": "{Question} \n First output the thinking process. During your thinking, you can use one of the tools if you think it might be helpful to answer the question. Once you are done, output the final answer in <answer> </answer> tags.",
    "no_think_tool_enforce": "{Question} \n First output the thinking process. During your reasoning, you must use the tool to answer the question. Once you are done, output the final answer in <answer> </answer> tags.",
    "pr_adapted": "{Question}\n\n" + _PR + " For an image, we can look closer by `{tool_name}`. " + _BOXED,
    "pr_adapted_exploration": "Explore the visual information present in the image. Determine if you can see more by employing the given visual operations (tools). For an image, we can look closer by `{tool_name}`. Describe the input image and the output images of the tool use (where applicable) in detail.",
    "pr_original": "{Question}\n\n" + _PR + " For a video, we can look closer by `{tool_name2}`. For an image, we can look closer by `{tool_name1}`. " + _BOXED,
    "no_tool": "{Question} \n Please think step by step, and put your final answer within \\boxed{}.",
}
DEFAULT_TEMPLATE = "{Question} \n " + _THINK


def not_true(c: str) -> Column:
    """Keeps false and NULL."""
    return ~F.col(c).eqNullSafe(True)


def has_prefix(c: str, prefix: str) -> Column:
    """NULL counts as no."""
    return F.coalesce(F.startswith(c, F.lit(prefix)), F.lit(False))


def as_text(c: str) -> Column:
    """Text form, NULL as ``None``."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def python_repr(texts: Column) -> Column:
    """An array of texts as Python prints its list: NULL as None, double quotes only around texts with single ones alone."""

    def shown(v: Column) -> Column:
        for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            v = F.replace(v, F.lit(plain), F.lit(escaped))
        return v

    def quoted(v: Column) -> Column:
        double = v.contains("'") & ~v.contains('"')
        return F.when(v.isNull(), "None").when(double, F.concat(F.lit('"'), shown(v), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(shown(v), F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(texts, quoted), ", "), F.lit("]"))


def basenames(paths: Column, folder: str = "data") -> Column:
    return F.transform(paths, lambda p: F.concat(F.lit(folder + "/"), F.element_at(F.split(p, "/"), -1)))


def under(paths: Column, folder: str) -> Column:
    """Paths under a folder; absolute ones stay."""
    return F.transform(paths, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(texts: pd.Series) -> pd.Series:
    """Python list literals as arrays; NULL where a text is none."""

    def one(t):
        try:
            v = ast.literal_eval(t)
        except (ValueError, SyntaxError, TypeError):
            return None
        return [str(x) for x in v] if isinstance(v, list) else None

    return texts.map(one)


def select_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*(c for c in wanted if c in df.columns))


def pixel_reasoner(df: DataFrame) -> DataFrame:
    """Rows that are no video and have one image; the boxed answer is unwrapped, a list in it read."""
    rows = df.where(not_true("is_video")).withColumn("image", literal_list("image")).where(F.size("image") == 1).withColumn("_a", literal_list("answer"))
    one = F.when(F.size("_a") == 1, F.get("_a", 0)).otherwise(F.raise_error(F.lit("Only one answer is expected")))
    inner = rows.withColumn("_a", F.substring(one, F.lit(8), F.length(one) - 8))
    many = F.when(F.col("_a").startswith("["), literal_list("_a"))
    return inner.select(F.col("question").alias("problem"), "image", F.coalesce(many, F.array("_a")).alias("solution"))


def vstar(df: DataFrame) -> DataFrame:
    """Without the image mark before the question and the box around the answer; one path or a list of them."""
    image = F.col("image")
    if df.schema["image"].dataType.simpleString() == "string":
        image = F.when(image.startswith("["), literal_list("image")).otherwise(F.array(image))
    answer = F.regexp_replace(F.regexp_replace(as_text("answer"), r"^\\boxed\{", ""), r"\}$", "")
    return df.select(F.regexp_replace(as_text("question"), "^<image>\n", "").alias("problem"), image.alias("image"), answer.alias("solution"))


def hr_bench(df: DataFrame) -> DataFrame:
    parts = [as_text("question")] + [F.concat(F.lit(f"({x}) "), as_text(x)) for x in "ABCD"] + [F.lit(LETTER)]
    return df.select(F.concat_ws("\n", *parts).alias("problem"), "image", F.col("answer").alias("solution"))


def mme(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\n", as_text("question"), F.array_join("`multi-choice options`", "\n"), F.lit(LETTER)).alias("problem"), "image", F.col("answer").alias("solution"))


def _single(image: str = "image") -> Column:
    return F.when(F.size(image) == 1, F.get(image, 0)).otherwise(F.raise_error(F.lit("Only one image is expected")))


def visual_probe(df: DataFrame) -> DataFrame:
    return df.select(F.col("question").alias("problem"), _single().alias("image"), F.col("answer").alias("solution"))


def deepeyes(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\n", "question", F.lit(LETTER_IF)).alias("problem"), _single().alias("image"), F.col("answer").alias("solution"))


CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pixel_reasoner": pixel_reasoner,
    "pixel_reasoner_vstar": vstar,
    "hr_bench_4k": hr_bench,
    "hr_bench_8k": hr_bench,
    "mme": mme,
    "mme_lite": mme,
    "visual_probe_train": visual_probe,
    "deepeyes_train_4k": deepeyes,
}


def convert(df: DataFrame, dataset: str) -> DataFrame:
    if dataset not in CONVERTERS:
        raise ValueError(f"unknown dataset {dataset!r}")
    return CONVERTERS[dataset](df)


def zip_join(left: DataFrame, right: DataFrame, key: str, order_left: str, order_right: str, take: list[str]) -> DataFrame:
    """Rows side by side in their orders; raises where the keys of a pair differ or one side is longer."""
    from tessera.operators.numbering import numbered

    a = numbered(left, order_left).withColumnRenamed("rn", "_rn")
    b = numbered(right, order_right).select(F.col("rn").alias("_rn"), F.col(key).alias("_key"), *(F.col(c) for c in take))
    both = a.join(b.withColumn("_right", F.lit(True)), "_rn", "full")
    aligned = F.col("_right").isNotNull() & F.col(order_left).isNotNull() & F.col(key).eqNullSafe(F.col("_key"))
    checked = both.withColumn(key, F.when(aligned, F.col(key)).otherwise(F.raise_error(F.lit("the two tables are not aligned")).cast(left.schema[key].dataType)))
    return checked.select(*left.columns, *take)


def template(task: str) -> str:
    return TEMPLATES.get(task, DEFAULT_TEMPLATE)


def template_column(task: Column) -> Column:
    out = F.lit(DEFAULT_TEMPLATE)
    for name, text in TEMPLATES.items():
        out = F.when(task == name, text).otherwise(out)
    return out


def name_tools(prompt: Column, tools: list[str], rename: bool = True) -> Column:
    """Fill ``{tool_name}``, or ``{tool_name1}`` ... for several; the normalised crop goes by its short name."""
    names = ["crop_image" if rename and t == "crop_image_normalized" else t for t in tools]
    if len(names) == 1:
        return F.replace(prompt, F.lit("{tool_name}"), F.lit(names[0]))
    for i, name in enumerate(names, 1):
        prompt = F.replace(prompt, F.lit(f"{{tool_name{i}}}"), F.lit(name))
    return prompt


def conversation(rows: DataFrame, question_prompt: str) -> DataFrame:
    """Boxed gold answers and the user prompt: an image part for each path, then the filled template."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))
    text = F.array(part("text", F.replace(F.lit(question_prompt), F.lit("{Question}"), F.col("problem"))))
    parts = F.concat(F.array_repeat(part("image", F.lit(None)), F.size("image_path")), text) if "image_path" in rows.columns else text
    if "image_path" in rows.columns:
        parts = F.when(F.col("image_path").isNotNull(), parts).otherwise(text)
    prompt = F.array(F.struct(F.lit("user").alias("role"), parts.alias("content")))
    boxed = F.transform("solution", lambda s: F.concat(F.lit("\\boxed{"), s, F.lit("}")))
    return rows.withColumn("solution", boxed).withColumn("prompt", prompt)


def fill_message(text: Column, fillers: dict[str, Column], wanted: list[str]) -> Column:
    """``<name>`` marks replaced; a wanted filler that is not given, or is NULL, raises."""
    for name in wanted:
        value = fillers[name].cast("string") if name in fillers else F.lit(None).cast("string")
        text = F.when(value.isNotNull(), F.replace(text, F.lit(f"<{name}>"), value)).otherwise(F.raise_error(F.lit(f"Missing filler: {name}")))
    return text


def redact_parts(parts: Column, path: Column) -> Column:
    """Inline images of message parts (type, text, image_url) replaced by their path."""
    return F.transform(parts, lambda p: F.when(p["type"] == "image_url", p.withField("image_url", path)).otherwise(p))


def customize(tool: dict, changes: dict[str, object]) -> dict:
    """A tool schema with values set at comma-separated paths."""
    import copy

    out = copy.deepcopy(tool)
    for path, value in changes.items():
        *parents, last = path.split(",")
        at = out
        for key in parents:
            at = at[key]
        at[last] = value
    return out


# The crop tool's schema.
ZOOM_SCHEMA = {
    "type": "function",
    "function": {
        "name": "zoom_in",
        "description": "Zoom in on the image based on the bounding box coordinates.",
        "parameters": {
            "type": "object",
            "properties": {
                "bbox_2d": {"type": "array", "description": "normalized coordinates for bounding box of the region you want to zoom in. Values should be within [0.0,1.0].", "items": {"type": "float"}},
                "target_image": {"type": "integer", "description": "The index of the image to crop. Index from 1 to the number of images. Choose 1 to operate on original image."},
            },
            "required": ["bbox_2d", "target_image"],
        },
    },
}
