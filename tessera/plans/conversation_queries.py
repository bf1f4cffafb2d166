"""Conversation algebra over ``conversations``, ``embeddings`` and tool calls derived from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import conversation as C
from tessera.plans.registry import Registry, table

registry = Registry()

# Assistant texts as tool calls of several kinds, by conversation and turn.
_CALLS = """
a AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, (turn * 10)::INT AS x, '<tool_call>{"name": "' || CASE WHEN (conv_id + turn) % 6 = 1 THEN 'crop_image' WHEN (conv_id + turn) % 6 = 2 THEN 'other' ELSE 'zoom_in' END ||
  '", "arguments": {"bbox_2d": [' || (turn * 10) || ', 20, 300, 400], "target_image": ' || (conv_id % 3) || '}}</tool_call>' AS call FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, k, x, CASE k WHEN 3 THEN 'plain reply' WHEN 4 THEN call || ' and ' || call WHEN 5 THEN '<tool_call>{bad json</tool_call>' ELSE 'look: ' || call END AS text FROM a)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 6
    name = F.when(k == 1, "crop_image").when(k == 2, "other").otherwise("zoom_in")
    call = F.concat(F.lit('<tool_call>{"name": "'), name, F.lit('", "arguments": {"bbox_2d": ['), F.col("turn") * 10, F.lit(', 20, 300, 400], "target_image": '), F.col("conv_id") % 3, F.lit("}}</tool_call>"))
    text = F.when(k == 3, "plain reply").when(k == 4, F.concat(call, F.lit(" and "), call)).when(k == 5, "<tool_call>{bad json</tool_call>").otherwise(F.concat(F.lit("look: "), call))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", text.alias("text"))


@registry.query(f"""
WITH {_CALLS} SELECT conv_id, turn, CASE WHEN k IN (0, 1, 2, 4) THEN CASE k WHEN 1 THEN 'crop_image' WHEN 2 THEN 'other' ELSE 'zoom_in' END END AS name, CASE WHEN k IN (0, 1, 2, 4) THEN x::DOUBLE END AS x1,
  CASE WHEN k IN (0, 1, 2) THEN (conv_id % 3)::INT END AS strict_target FROM c""")
def k_extract_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _calls(spark, sf_dir).withColumn("c", C.extract_tool(F.col("text"))).withColumn("s", C.extract_tool(F.col("text"), strict=True))
    return t.select("conv_id", "turn", F.col("c.name").alias("name"), F.get("c.arguments.bbox_2d", 0).alias("x1"), F.col("s.arguments.target_image").alias("strict_target"))


@registry.query(f"WITH {_CALLS} SELECT conv_id, turn, k <> 3 AS attempted, k IN (0, 1, 4) AS named, k IN (0, 1, 2, 4) AND conv_id % 3 BETWEEN 1 AND 1 AS in_bounds FROM c")
def k_tool_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _calls(spark, sf_dir).withColumn("c", C.extract_tool(F.col("text")))
    return t.select("conv_id", "turn", C.attempted(F.col("text")).alias("attempted"), C.names_tool(F.col("c.name"), ["zoom_in", "crop_image_normalized"]).alias("named"), C.target_in_bounds(F.col("c.arguments.target_image"), F.lit(1)).alias("in_bounds"))


@registry.query(f"WITH {_CALLS} SELECT conv_id, count(*) FILTER (k IN (0, 1, 4)) AS n_success, count(*) FILTER (k <> 3) AS n_attempt FROM c GROUP BY conv_id")
def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _calls(spark, sf_dir).withColumn("ok", C.names_tool(C.extract_tool(F.col("text"))["name"], ["zoom_in", "crop_image_normalized"])).withColumn("tried", C.attempted(F.col("text")))
    return C.tool_counts(t, "conv_id", "ok", "tried")


@registry.query(f"WITH {_CALLS} SELECT conv_id, turn, CASE WHEN k IN (0, 1, 2, 4) THEN regexp_replace(text, '\\[[^]]*\\]', '[1, 2, ' || x || ', 4]') END AS text FROM c")
def replace_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.array(F.lit(1), F.lit(2), (F.col("turn") * 10).cast("int"), F.lit(4))
    return _calls(spark, sf_dir).select("conv_id", "turn", C.replace_bbox(F.col("text"), new).alias("text"))


@registry.query(f"""
WITH {_CALLS}, o AS (SELECT *, row_number() OVER w AS round, k <> 3 AS attempted, k IN (0, 1, 4) AS named, 1 + coalesce(sum(CASE WHEN k IN (0, 1, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, named AND conv_id % 3 BETWEEN 1 AND n AS successful FROM o), u AS (SELECT *, sum(successful::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS uses FROM s),
f AS (SELECT *, (NOT attempted) OR uses > 2 OR round >= 5 AS finished FROM u), r AS (SELECT *, coalesce(max(finished) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM f)
SELECT conv_id, turn, round, attempted, successful, finished FROM r WHERE NOT over""")
def conv_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rounds(_calls(spark, sf_dir).withColumn("n_images", F.lit(1)), "conv_id", "turn", ["zoom_in", "crop_image_normalized"], max_rounds=5, max_tool_uses=2)


@registry.query(f"""
WITH {_CALLS} SELECT conv_id, turn, 'img_' || conv_id || '.png' AS original_image, CASE WHEN k = 1 THEN 'crop_image' ELSE 'zoom_in' END AS tool, x AS x1, sha256(conv_id || ':' || turn) AS new_image FROM c WHERE k IN (0, 1, 4) AND conv_id % 3 = 1""")
def tool_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _calls(spark, sf_dir).withColumn("c", C.extract_tool(F.col("text"))).where(C.names_tool(F.col("c.name"), ["zoom_in", "crop_image_normalized"]) & C.target_in_bounds(F.col("c.arguments.target_image"), F.lit(1)))
    return t.select("conv_id", "turn", F.concat(F.lit("img_"), "conv_id", F.lit(".png")).alias("original_image"), F.col("c.name").alias("tool"), F.get("c.arguments.bbox_2d", 0).cast("int").alias("x1"), F.sha2(F.concat_ws(":", "conv_id", "turn"), 256).alias("new_image"))


# Turns as they are -------------------------------------------------------

_WRAP = "'<|im_start|>' || role || E'\\n' || text || CASE WHEN role = 'assistant' AND ends_with(text, '<|im_end|>') THEN '' ELSE '<|im_end|>' END"
_TURNS = "t AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 1 THEN text || '<|im_end|>' ELSE text END AS text FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit(C.TURN_END))).otherwise(F.col("text")))


@registry.query(f"WITH {_TURNS} SELECT conv_id, turn, {_WRAP} AS wrapped FROM t")
def wrap_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", C.wrap_text(F.col("role"), F.col("text")).alias("wrapped"))


@registry.query(f"WITH {_TURNS}, s AS (SELECT conv_id, string_agg({_WRAP}, E'\\n' ORDER BY turn) AS s, max_by(role, turn) AS last FROM t GROUP BY conv_id) SELECT conv_id, s || CASE WHEN last = 'user' THEN E'\\n<|im_start|>assistant\\n' ELSE '' END AS sequence FROM s")
def serialize_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.serialize(_turns(spark, sf_dir), "conv_id", "turn", add_assistant_start=True)


@registry.query(f"""
WITH {_TURNS}, w AS (SELECT conv_id, turn, length('<|im_start|>' || role || E'\\n') AS h, length(text) AS b, length({_WRAP}) + 1 AS l FROM t)
SELECT conv_id, turn, coalesce(sum(l) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + h AS "start", coalesce(sum(l) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + h + b AS "end" FROM w""")
def turn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("w", F.length(C.wrap_text(F.col("role"), F.col("text"))))
    head = F.length(F.concat(F.lit(C.TURN_START), "role", F.lit("\n")))
    return C.offsets(t, "conv_id", "turn", head, F.length("text"), F.col("w") - head - F.length("text")).select("conv_id", "turn", "start", "end")


@registry.query("""
WITH m AS (SELECT conv_id, turn, '000' || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, (length(text) % 9)::INT) || CASE WHEN role = 'assistant' AND turn % 2 = 0 THEN '' ELSE '0' END AS m FROM conversations)
SELECT conv_id, string_agg(m, '0' ORDER BY turn) AS mask FROM m GROUP BY conv_id""")
def gen_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("mask", C.turn_mask(F.col("role"), (F.length("text") % 9).cast("int"), F.col("turn") % 2 == 0))
    return C.conversation_mask(t, "conv_id", "turn", "mask").select("conv_id", F.array_join("mask", "").alias("mask"))


@registry.query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS generation, string_agg(length(text)::VARCHAR, ',' ORDER BY turn) AS lens FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def model_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.generations(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn("lens", F.array_join("lens", ","))


@registry.query("SELECT conv_id, sum(length(text)) AS total_len, count(*) AS n_turns FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def generation_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.generations(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return g.select("conv_id", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_len"), F.size("lens").cast("long").alias("n_turns"))


@registry.query("SELECT conv_id, coalesce(string_agg(CASE WHEN turn % 3 <> 1 THEN 'p' || turn || CASE WHEN turn % 3 = 2 THEN ',q' || turn ELSE '' END END, ',' ORDER BY turn), '') AS images FROM conversations GROUP BY conv_id")
def conv_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.concat(F.lit("p"), "turn"), F.concat(F.lit("q"), "turn")
    t = table(spark, sf_dir, "conversations").withColumn("paths", F.when(F.col("turn") % 3 == 0, F.array(p)).when(F.col("turn") % 3 == 2, F.array(p, q)))
    return C.images(t, "conv_id", "turn", "paths").withColumn("images", F.array_join("images", ","))


@registry.query("""
WITH r AS (SELECT conv_id, turn, sum(turn % 3) OVER (PARTITION BY conv_id ORDER BY turn) AS cum FROM conversations), l AS (SELECT DISTINCT conv_id, i FROM conversations, range(4) g(i))
SELECT l.conv_id, l.i, min(r.turn) AS image_turn FROM l LEFT JOIN r ON r.conv_id = l.conv_id AND r.cum > l.i GROUP BY ALL""")
def image_turn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("n", F.col("turn") % 3)
    lookups = t.select("conv_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return C.image_turn(t, "conv_id", "turn", "n", lookups, "i")


@registry.query("""
WITH RECURSIVE b AS (SELECT conv_id, turn AS k, CASE WHEN turn % 2 = 0 THEN turn // 2 ELSE 0 END AS target, (turn * 7) AS x1, (turn * 5) AS y1, turn * 7 + 30 AS x2, turn * 5 + 40 AS y2 FROM conversations WHERE turn > 0),
c AS (SELECT conv_id, k, target AS up, x1, y1, x2, y2 FROM b UNION ALL SELECT c.conv_id, c.k, p.target, c.x1 + p.x1, c.y1 + p.y1, c.x2 + p.x1, c.y2 + p.y1 FROM c JOIN b p ON p.conv_id = c.conv_id AND p.k = c.up WHERE c.up > 0)
SELECT conv_id, k, x1, y1, x2, y2 FROM c WHERE up = 0 OR NOT EXISTS (SELECT 1 FROM b WHERE b.conv_id = c.conv_id AND b.k = c.up)""")
def bbox_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("turn > 0").selectExpr("conv_id", "turn AS k", "CASE WHEN turn % 2 = 0 THEN turn div 2 ELSE 0 END AS target", "turn * 7 AS x", "turn * 5 AS y")
    calls = t.select("conv_id", "k", "target", G.box(F.col("x"), F.col("y"), F.col("x") + 30, F.col("y") + 40).alias("box"))
    return C.bbox_chain(calls, "conv_id", "k", "target", "box").select("conv_id", "k", "box.*")


@registry.query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(turn, ('0x' || substr(md5('9:' || conv_id || ':' || turn), 1, 13))::BIGINT) AS random_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def turn_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    pick = lambda how: C.pick_turn(t, "conv_id", "turn", how, seed=9).withColumnRenamed("picked", f"{how}_turn")
    return pick("first").join(pick("last"), "conv_id").join(pick("random"), "conv_id")


@registry.query("""
WITH r AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' AND turn % 4 >= 2 THEN 'tool' ELSE role END AS role FROM conversations),
w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM r),
p AS (SELECT conv_id, turn, CASE WHEN n = 1 AND role = 'system' THEN text END AS sys, CASE WHEN n = 1 AND role = 'system' THEN '' WHEN role = 'tool' THEN CASE WHEN b IS DISTINCT FROM 'tool' THEN '<|im_start|>user' ELSE '' END || E'\\n<tool_response>\\n' || text || E'\\n</tool_response>' || CASE WHEN a IS DISTINCT FROM 'tool' THEN E'<|im_end|>\\n' ELSE '' END
  ELSE '<|im_start|>' || role || E'\\n' || text || E'<|im_end|>\\n' END AS part FROM w)
SELECT conv_id, E'<|im_start|>system\\n' || coalesce(max(sys), 'You are a helpful assistant.') || E'<|im_end|>\\n' || string_agg(part, '' ORDER BY turn) || E'<|im_start|>assistant\\n' AS prompt FROM p GROUP BY conv_id""")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("role", F.when((F.col("role") == "user") & (F.col("turn") % 4 >= 2), "tool").otherwise(F.col("role")))
    return C.chat_template(t, "conv_id", "turn")


# Token arrays from embeddings --------------------------------------------

_IDS = "i AS (SELECT vec_id, list_concat([5, 1], list_transform(range(vec_id % 7), lambda x: 9), [2, 6], CASE WHEN vec_id % 2 = 0 THEN list_concat([1], list_transform(range(vec_id % 4), lambda x: 9), [2]) ELSE [1, 7] END, [8]) AS ids FROM embeddings)"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda *xs: F.array(*(F.lit(x) for x in xs))
    pads = lambda n: F.array_repeat(F.lit(9), (F.col("vec_id") % n).cast("int"))
    tail = F.when(F.col("vec_id") % 2 == 0, F.concat(a(1), pads(4), a(2))).otherwise(a(1, 7))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(a(5, 1), pads(7), a(2, 6), tail, a(8)).alias("ids"))


@registry.query("SELECT vec_id, '5,1,9,2,6,' || CASE WHEN vec_id % 2 = 0 THEN '1,9,2' ELSE '1,7' END || ',8' AS ids, (vec_id % 7) || CASE WHEN vec_id % 2 = 0 THEN ',' || (vec_id % 4) ELSE '' END AS lens FROM embeddings")
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _ids(spark, sf_dir).withColumn("c", C.rle_encode(F.col("ids"), 1, 2, 9))
    return t.select("vec_id", F.array_join("c.ids", ",").alias("ids"), F.array_join("c.lens", ",").alias("lens"))


@registry.query(f"WITH {_IDS} SELECT vec_id, array_to_string(ids, ',') AS ids FROM i")
def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _ids(spark, sf_dir).withColumn("c", C.rle_encode(F.col("ids"), 1, 2, 9))
    return t.select("vec_id", F.array_join(C.rle_decode(F.col("c.ids"), F.col("c.lens"), 1, 2, 9), ",").alias("ids"))


@registry.query(f"WITH {_IDS} SELECT vec_id, len(ids) AS n, 5 + CASE WHEN vec_id % 2 = 0 THEN 3 ELSE 2 END + 1 AS n_coded FROM i")
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("vec_id", F.size("ids").cast("long").alias("n"), F.size(C.checked_rle(F.col("ids"), 1, 2, 9)["ids"]).cast("long").alias("n_coded"))


@registry.query(f"""
WITH {_IDS} SELECT vec_id, list_max(list_filter(range(len(ids) - 1), lambda p: ids[p + 1] = 1 AND ids[p + 2] = 9)) AS last_pair, list_max(list_filter(range(len(ids)), lambda p: ids[p + 1] = 1)) AS last_start FROM i""")
def rindex_subseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("ids")
    return _ids(spark, sf_dir).select("vec_id", C.rindex(ids, F.array(F.lit(1), F.lit(9))).alias("last_pair"), C.rindex(ids, F.array(F.lit(1))).alias("last_start"))


@registry.query(f"""
WITH {_IDS}, m AS (SELECT vec_id, ids, max(len(ids)) OVER (PARTITION BY vec_id % 5) AS n FROM i) SELECT vec_id, array_to_string(list_concat(list_transform(range(n - len(ids)), lambda x: 0), ids), ',') AS ids FROM m""")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _ids(spark, sf_dir).withColumn("batch", F.col("vec_id") % 5)
    return C.pad_batch(t, "batch", "ids", 0, "left").select("vec_id", F.array_join("ids", ",").alias("ids"))


@registry.query(f"WITH {_IDS} SELECT vec_id, array_to_string(ids, ',') AS l, array_to_string(ids, ',') AS r FROM i")
def strip_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = _ids(spark, sf_dir).select("vec_id", *(C.pad_to(F.col("ids"), F.lit(40), 0, s).alias(s) for s in ("left", "right")))
    return padded.select("vec_id", F.array_join(C.strip_pad(F.col("left"), 0, "left"), ",").alias("l"), F.array_join(C.strip_pad(F.col("right"), 0), ",").alias("r"))


@registry.query("SELECT vec_id, round(list_sum(list_reverse_sort(embedding)[1:5])::DOUBLE, 4) AS top5, round(list_sum(embedding[1:5])::DOUBLE, 4) AS first5 FROM embeddings")
def topk_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", total(C.top_k(F.col("embedding"), 5)).alias("top5"), total(F.slice("embedding", 1, 5)).alias("first5"))


@registry.query("""
WITH c AS (SELECT vec_id, generate_subscripts(n, 1) - 1 AS img, unnest(n) AS length FROM (SELECT vec_id, [vec_id % 4 + 1, vec_id % 3 + 2, vec_id % 5] AS n FROM embeddings))
SELECT vec_id, img::INT AS img, sum(length) OVER (PARTITION BY vec_id ORDER BY img) - length AS "start", length FROM c""")
def patch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.array(v % 4 + 1, v % 3 + 2, v % 5).alias("n"))
    return t.select("vec_id", F.posexplode(C.split_patches(F.col("n"))).alias("img", "s")).select("vec_id", "img", "s.start", "s.length")


@registry.query(f"""
WITH {_IDS}, p AS (SELECT vec_id, ids, list_max(list_filter(range(len(ids)), lambda p: ids[p + 1] = 1)) AS cut FROM i)
SELECT vec_id, array_to_string(list_concat(ids[1:cut], [3, 3, 4], [vec_id % 9]), ',') AS ids, cut + 3 AS "start", cut + 4 AS "end" FROM p""")
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _ids(spark, sf_dir).withColumn("cut", C.rindex(F.col("ids"), F.array(F.lit(1))))
    out = C.counterfactual(F.col("ids"), F.col("cut"), F.size("ids"), F.array(F.lit(3), F.lit(3), F.lit(4)), F.array((F.col("vec_id") % 9).cast("int")))
    return t.withColumn("c", out).select("vec_id", F.array_join("c.ids", ",").alias("ids"), "c.start", "c.end")
