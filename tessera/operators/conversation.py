"""Conversation algebra: tool calls, token arrays, masks, serialisation and crop chains.

A turn is one row (conversation, turn index, role, text or ids, flags); a
conversation is its turns in order. Per-turn work is a projection; what needs
the order uses windows or ordered aggregates over one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G

# Markers of tool calls and turns.
TOOL_START, TOOL_END = "<tool_call>", "</tool_call>"
TURN_START, TURN_END, SEPARATOR = "<|im_start|>", "<|im_end|>", "\n"
IMAGE, VIDEO = "<|vision_start|><|image_pad|><|vision_end|>", "<|vision_start|><|video_pad|><|vision_end|>"
DEFAULT_SYSTEM = "You are a helpful assistant."
CALL_SCHEMA = "struct<name:string,arguments:struct<bbox_2d:array<double>,target_image:int>>"
#: Names by which a tool may be called besides its own.
ALIASES = {"crop_image_normalized": ("crop_image",)}


def _quote(marker: str) -> str:
    return rf"\Q{marker}\E"


def count_of(text: Column, marker: str) -> Column:
    return F.size(F.split(text, _quote(marker), -1)) - 1


# Tool calls --------------------------------------------------------------


def tool_text(text: Column, strict: bool = False, position: str = "last") -> Column:
    """The call between the first or last start marker and the next end marker; NULL without a start, or where strict rules fail."""
    if position not in ("first", "last"):
        raise ValueError(f"unknown position: {position}")
    parts = F.split(text, _quote(TOOL_START), -1)
    after = F.get(parts, 1) if position == "first" else F.element_at(parts, -1)
    content = F.get(F.split(after, _quote(TOOL_END), -1), 0)
    fine = (count_of(text, TOOL_START) == 1) & (count_of(text, TOOL_END) == 1) & text.endswith(TOOL_END) if strict else F.lit(True)
    # Without a start marker the original reads the whole text before an end marker in ``last`` mode.
    return F.when(fine, content)


def extract_tool(text: Column, strict: bool = False, position: str = "last") -> Column:
    """The parsed call; NULL where there is none or it is no JSON object."""
    call = F.from_json(tool_text(text, strict, position), CALL_SCHEMA)
    return F.when(call["name"].isNotNull() | call["arguments"].isNotNull(), call)


def attempted(text: Column) -> Column:
    return text.contains(TOOL_START) | text.contains(TOOL_END)


def names_tool(name: Column, tools: list[str]) -> Column:
    return F.coalesce(name.isin(*{n for t in tools for n in (t, *ALIASES.get(t, ()))}), F.lit(False))


def target_in_bounds(target: Column, n_images: Column) -> Column:
    """1-based image number of a call."""
    return F.coalesce(target.between(1, n_images), F.lit(False))


def replace_bbox(text: Column, bbox: Column) -> Column:
    """The text with its first bracketed list replaced by the four numbers; NULL where there is none."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(bbox, lambda v: v.cast("string")), ", "), F.lit("]"))
    at = F.regexp_instr(text, F.lit(r"\[[^\]]*\]"))
    old = F.regexp_extract(text, r"\[[^\]]*\]", 0)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), listed, F.substring(text, at + F.length(old), F.length(text))))


# Token arrays ------------------------------------------------------------


def rle_encode(ids: Column, start: int, end: int, pad: int) -> Column:
    """(ids with one pad an image, run lengths): pads are dropped and counted, each end marker brings one back."""
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.array().cast("array<int>").alias("lens"), F.lit(0).alias("run"))

    def step(s: Column, x: Column) -> Column:
        out = F.when(x == pad, s["out"]).when(x == end, F.concat(s["out"], F.array(F.lit(pad), F.lit(end)))).otherwise(F.array_append(s["out"], x))
        lens = F.when(x == end, F.array_append(s["lens"], s["run"])).otherwise(s["lens"])
        run = F.when(x == start, 0).when(x == pad, s["run"] + 1).otherwise(s["run"])
        return F.struct(out.alias("out"), lens.alias("lens"), run.alias("run"))

    return F.aggregate(ids, zero, step, lambda s: F.struct(s["out"].alias("ids"), s["lens"].alias("lens")))


def rle_decode(ids: Column, lens: Column, start: int, end: int, pad: int) -> Column:
    """Inverse of ``rle_encode``: each (start, pad, end) takes its run length, missing lengths are 0; other starts are copied."""
    n = F.size(ids)
    at = lambda i: F.get(ids, i)
    opens = lambda i: F.coalesce((i >= 0) & (at(i) == start) & (at(i + 1) == pad) & (at(i + 2) == end), F.lit(False))
    place = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: opens(i))
    expanded = F.transform(ids, lambda x, i: F.when(opens(i - 1), F.array_repeat(F.lit(pad), F.coalesce(F.get(lens, F.array_position(place, i - 1).cast("int") - 1), F.lit(0)))).otherwise(F.array(x)))
    return F.when(n == 0, ids).otherwise(F.flatten(expanded))


def checked_rle(ids: Column, start: int, end: int, pad: int) -> Column:
    """``rle_encode`` that raises where decoding would not give the ids back."""
    coded = rle_encode(ids, start, end, pad)
    return F.when(rle_decode(coded["ids"], coded["lens"], start, end, pad) == ids, coded).otherwise(F.raise_error(F.lit("image pads cannot be restored")).cast("struct<ids:array<int>,lens:array<int>>"))


def rindex(ids: Column, sub: Column) -> Column:
    """0-based start of the last occurrence of the sub-sequence; NULL if absent or empty."""
    m = F.size(sub)
    starts = F.when((m > 0) & (F.size(ids) >= m), F.sequence(F.lit(0), F.size(ids) - m)).otherwise(F.array().cast("array<int>"))
    return F.array_max(F.filter(starts, lambda i: F.slice(ids, i + 1, m) == sub))


def pad_to(ids: Column, length: Column, value: int, side: str = "right") -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)))
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def pad_batch(rows: DataFrame, batch: str, ids: str, value: int, side: str = "right") -> DataFrame:
    """Ids padded to the longest of their batch; only lengths are gathered per batch."""
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("_longest"))
    return rows.join(longest, batch).withColumn(ids, pad_to(F.col(ids), F.col("_longest"), value, side)).drop("_longest")


def strip_pad(ids: Column, value: int, side: str = "right") -> Column:
    """Ids without padding on one side; raises where there is nothing else."""
    real = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0))), lambda i: F.get(ids, i) != value)
    out = F.slice(ids, 1, F.array_max(real) + 1) if side == "right" else F.slice(ids, F.array_min(real) + 1, F.size(ids))
    return F.when(F.size(real) > 0, out).otherwise(F.raise_error(F.lit("the sequence is all padding")).cast("array<int>"))


def top_k(values: Column, k: int) -> Column:
    return F.slice(F.reverse(F.array_sort(values)), 1, k)


def split_patches(counts: Column) -> Column:
    """(start, length) of each image's patches in the flat list."""
    ends = F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.transform(F.arrays_zip(ends.alias("e"), counts.alias("n")), lambda s: F.struct((s["e"] - s["n"]).alias("start"), s["n"].alias("length")))


# Turns -------------------------------------------------------------------


def wrap_text(role: Column, text: Column, dummy: Column | None = None) -> Column:
    """Turn header, text, and end marker; an assistant's own end marker counts, a dummy has none."""
    ends = (role == "assistant") & text.endswith(TURN_END)
    tail = F.when(ends | (F.lit(False) if dummy is None else dummy), "").otherwise(TURN_END)
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, tail)


def wrap_ids(role: Column, ids: Column, role_ids: dict[str, int], start: int, newline: int, end: int, dummy: Column | None = None) -> Column:
    """The same over ids: start, role, newline, ids, end."""
    role_id = F.lit(None).cast("int")
    for name, i in role_ids.items():
        role_id = F.when(role == name, i).otherwise(role_id)
    ends = (role == "assistant") & F.coalesce(F.try_element_at(ids, F.lit(-1)) == end, F.lit(False))
    tail = F.when(ends | (F.lit(False) if dummy is None else dummy), F.array().cast("array<int>")).otherwise(F.array(F.lit(end)))
    return F.concat(F.array(F.lit(start), role_id, F.lit(newline)), ids, tail)


def turn_mask(role: Column, n_ids: Column, ends_with_end: Column) -> Column:
    """1 for the model's tokens: three header zeros, the ids, and a zero for an end marker that is not the model's."""
    own = role == "assistant"
    body = F.array_repeat(own.cast("int"), n_ids)
    tail = F.when(own & ends_with_end, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    return F.concat(F.array_repeat(F.lit(0), F.lit(3)), body, tail)


def _ordered(turns: DataFrame, conv: str, turn: str, *columns: Column) -> DataFrame:
    return turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("_t"), *columns))).alias("_turns"))


def serialize(turns: DataFrame, conv: str, turn: str, add_assistant_start: bool = False) -> DataFrame:
    """Conversation texts: wrapped turns with a line break between; optionally an open assistant turn after a user turn."""
    rows = _ordered(turns, conv, turn, F.col("role"), wrap_text(F.col("role"), F.col("text")).alias("_w"))
    text = F.array_join(F.transform("_turns", lambda t: t["_w"]), SEPARATOR)
    if add_assistant_start:
        text = F.when(F.element_at("_turns", -1)["role"] == "user", F.concat(text, F.lit(f"{SEPARATOR}{TURN_START}assistant\n"))).otherwise(text)
    return rows.select(conv, text.alias("sequence"))


def offsets(turns: DataFrame, conv: str, turn: str, header: Column, body: Column, tail: Column) -> DataFrame:
    """Start and end of each turn's own content in the serialised conversation, separators of one included."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    sized = turns.withColumn("_h", header).withColumn("_b", body).withColumn("_l", header + body + tail + 1)
    return sized.withColumn("start", F.coalesce(F.sum("_l").over(before), F.lit(0)) + F.col("_h")).withColumn("end", F.col("start") + F.col("_b")).drop("_h", "_b", "_l")


def conversation_mask(turns: DataFrame, conv: str, turn: str, mask: str) -> DataFrame:
    """Turn masks joined with a zero for each separator."""
    rows = _ordered(turns, conv, turn, F.col(mask).alias("m"))
    joined = F.flatten(F.transform("_turns", lambda t, i: F.concat(F.when(i > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), t["m"])))
    return rows.select(conv, joined.alias(mask))


def generations(turns: DataFrame, conv: str, turn: str) -> DataFrame:
    """The assistant's texts joined, and the length of each."""
    rows = _ordered(turns.where(F.col("role") == "assistant"), conv, turn, F.col("text"))
    return rows.select(conv, F.array_join(F.transform("_turns", lambda t: t["text"]), "").alias("generation"), F.transform("_turns", lambda t: F.length(t["text"])).alias("lens"))


def images(turns: DataFrame, conv: str, turn: str, paths: str) -> DataFrame:
    """All image paths of a conversation in turn order; NULL lists have none."""
    rows = _ordered(turns, conv, turn, F.coalesce(paths, F.array().cast("array<string>")).alias("p"))
    return rows.select(conv, F.flatten(F.transform("_turns", lambda t: t["p"])).alias("images"))


def tool_counts(turns: DataFrame, conv: str, success: str, attempt: str) -> DataFrame:
    return turns.groupBy(conv).agg(F.count_if(success).alias("n_success"), F.count_if(attempt).alias("n_attempt"))


def image_turn(turns: DataFrame, conv: str, turn: str, n_images: str, lookups: DataFrame, index: str) -> DataFrame:
    """For each (conversation, 0-based image index): the first turn whose running image count exceeds it."""
    running = turns.withColumn("_cum", F.sum(n_images).over(Window.partitionBy(conv).orderBy(turn))).select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), "_cum")
    hits = lookups.join(running, (F.col(conv) == F.col("_c")) & (F.col("_cum") > F.col(index)), "left")
    return hits.groupBy(*lookups.columns).agg(F.min("_t").alias("image_turn"))


def bbox_chain(calls: DataFrame, conv: str, call: str, target: str, box: str) -> DataFrame:
    """Boxes in original coordinates: a crop of a crop is moved by its parents' corners.

    ``target`` 0 is the original image, k the crop of call k; a target that no
    earlier call made counts as the original. The calls of a conversation are
    gathered in order and folded once, however long the chains are.
    """
    long = F.struct(*(F.col(box)[c].cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))
    others = [c for c in calls.columns if c not in (conv, call, target, box)]
    row = F.struct(F.col(call).alias("k"), F.col(target).alias("up"), long.alias("box"), F.struct(*others).alias("rest") if others else F.lit(0).alias("rest"))
    gathered = calls.groupBy(conv).agg(F.sort_array(F.collect_list(row)).alias("_calls"))
    corner = lambda k, b: F.struct(k.alias("k"), b["x1"].alias("x"), b["y1"].alias("y"))

    def step(done: Column, c: Column) -> Column:
        moved = F.transform(F.filter(done["corners"], lambda p: p["k"] == c["up"]), lambda p: G.shift(c["box"], p["x"], p["y"]))
        placed = F.coalesce(F.get(moved, 0), c["box"])
        return F.struct(F.array_append(done["corners"], corner(c["k"], placed)).alias("corners"), F.array_append(done["boxes"], placed).alias("boxes"))

    kind = gathered.schema["_calls"].dataType.elementType
    start = F.struct(F.array().cast(f"array<struct<k:{kind['k'].dataType.simpleString()},x:bigint,y:bigint>>").alias("corners"), F.array().cast("array<struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>>").alias("boxes"))
    boxes = F.aggregate("_calls", start, step, lambda done: done["boxes"])
    out = gathered.select(conv, F.explode(F.arrays_zip(F.col("_calls").alias("c"), boxes.alias("b"))).alias("_r"))
    return out.select(conv, F.col("_r.c.k").alias(call), F.col("_r.c.up").alias(target), F.col("_r.b").alias(box), *(F.col(f"_r.c.rest.{c}").alias(c) for c in others)).select(*calls.columns)


# Rounds ------------------------------------------------------------------


def rounds(replies: DataFrame, conv: str, turn: str, tools: list[str], max_rounds: int = 10, max_tool_uses: int = 5, strict: bool = False, stop_on_error: bool = False) -> DataFrame:
    """Replay of recorded replies through the tool loop: one row per reply that was reached.

    ``replies`` has one row per assistant turn: role order, text, and ``n_images``
    known before the first call. A reply without markers, a wrong call when
    ``stop_on_error``, more than ``max_tool_uses`` good calls, or the round limit
    ends the conversation; later replies are not reached.
    """
    w = Window.partitionBy(conv).orderBy(turn)
    call = extract_tool(F.col("text"), strict)
    parsed = replies.withColumn("round", F.row_number().over(w)).withColumn("attempted", attempted(F.col("text"))).withColumn("_call", F.when(F.col("attempted"), call))
    named = parsed.withColumn("_named", names_tool(F.col("_call.name"), tools) & F.coalesce(F.size("_call.arguments.bbox_2d") == 4, F.lit(False)))
    # A good call adds an image: targets may name the images made so far by named calls.
    made = F.coalesce(F.sum(F.col("_named").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = named.withColumn("successful", F.col("attempted") & F.coalesce(F.col("_named"), F.lit(False)) & target_in_bounds(F.col("_call.arguments.target_image"), F.col("n_images") + made))
    uses = F.sum(F.col("successful").cast("int")).over(w)
    ended = ~F.col("attempted") | (uses > max_tool_uses) | (F.col("round") >= max_rounds) | (F.lit(stop_on_error) & F.col("attempted") & ~F.col("successful"))
    flagged = tried.withColumn("finished", ended)
    reached = F.coalesce(F.max("finished").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return flagged.withColumn("_over", reached).where(~F.col("_over")).select(conv, turn, "round", "attempted", "successful", "finished")


def ids_by_finished(replies: DataFrame, conv: str, finished: str, wanted: bool) -> DataFrame:
    """Conversations that are finished, or are not: one is when its last reply is."""
    return replies.groupBy(conv).agg(F.bool_or(finished).alias("_done")).where(F.col("_done") == wanted).select(conv)


def trim_over_limit(turns: DataFrame, conv: str, turn: str, limit: int) -> DataFrame:
    """Training's rule: the call over the limit is un-counted and the tool result after it dropped."""
    w = Window.partitionBy(conv).orderBy(turn)
    counted = turns.withColumn("_n", F.sum(F.col("successful").cast("int")).over(w)).withColumn("_before", F.coalesce(F.lag("_n").over(w), F.lit(0)))
    over = (F.col("_n") > limit) & F.col("successful")
    return counted.where(F.col("_before") <= limit).withColumn("successful", F.col("successful") & ~over).drop("_n", "_before")


def counterfactual(ids: Column, call_start: Column, call_end: Column, bridge: Column, answer: Column) -> Column:
    """The sequence cut at the tool call, bridged, then answered, with the answer's span: (ids, start, end)."""
    head = F.slice(ids, F.lit(1), call_start)
    joined = F.concat(head, bridge, answer)
    return F.when((call_start >= 0) & (call_end > call_start), F.struct(joined.alias("ids"), (F.size(joined) - F.size(answer)).alias("start"), F.size(joined).alias("end")))


def pick_turn(turns: DataFrame, conv: str, turn: str, how: str, seed: int = 0) -> DataFrame:
    """First, last or drawn candidate turn of each conversation."""
    from tessera.operators.policy import draw

    if how == "first":
        out = F.min(turn)
    elif how == "last":
        out = F.max(turn)
    elif how == "random":
        out = F.min(F.struct(draw(seed, conv, turn).alias("d"), F.col(turn).alias("t")))["t"]
    else:
        raise ValueError(f"unknown choice: {how}")
    return turns.groupBy(conv).agg(out.alias("picked"))


def chat_template(turns: DataFrame, conv: str, turn: str, tools: Column | None = None, generation_prompt: bool = True) -> DataFrame:
    """The chat layout: system text, tool block, turns, tool results gathered in one user turn, open assistant turn."""
    w = Window.partitionBy(conv).orderBy(turn)
    is_tool = F.col("role") == "tool"
    before, after = F.coalesce(F.lag("role").over(w), F.lit("")), F.coalesce(F.lead("role").over(w), F.lit(""))
    head = F.when(~is_tool, F.concat(F.lit(TURN_START), "role", F.lit("\n"))).otherwise(F.concat(F.when(before != "tool", f"{TURN_START}user").otherwise(""), F.lit("\n<tool_response>\n")))
    tail = F.when(~is_tool, f"{TURN_END}\n").otherwise(F.concat(F.lit("\n</tool_response>"), F.when(after != "tool", f"{TURN_END}\n").otherwise("")))
    first = F.row_number().over(w) == 1
    parts = turns.withColumn("_sys", F.when(first & (F.col("role") == "system"), F.col("text"))).withColumn("_part", F.when(F.col("_sys").isNull(), F.concat(head, "text", tail)).otherwise(""))
    rows = _ordered(parts, conv, turn, F.col("_part").alias("p"), F.col("_sys").alias("s"))
    system = F.coalesce(F.get("_turns", 0)["s"], F.lit(DEFAULT_SYSTEM))
    block = F.lit("") if tools is None else F.concat(F.lit("\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n"), F.array_join(tools, "\n"), F.lit('\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'))
    text = F.concat(F.lit(f"{TURN_START}system\n"), system, block, F.lit(f"{TURN_END}\n"), F.array_join(F.transform("_turns", lambda t: t["p"]), ""), F.lit(f"{TURN_START}assistant\n" if generation_prompt else ""))
    return rows.select(conv, text.alias("prompt"))
