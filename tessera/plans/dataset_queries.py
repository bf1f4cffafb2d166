"""Sources, converters, prompts, generation and evaluation plans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import convert as V
from tessera.operators import generate as N
from tessera.plans import configgrid as P
from tessera.plans.registry import Registry, table
from tessera.sources import readers as R

registry = Registry()
query = registry.query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Sources -----------------------------------------------------------------

@query("SELECT page_id, sha256(encode(url)) || '.jpg' AS name, length(url) AS n FROM pages WHERE url IS NOT NULL")
def b64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("url is not null").withColumn("i", R.decode_image(F.base64(F.encode("url", "UTF-8"))))
    return p.select("page_id", F.col("i.name").alias("name"), F.octet_length("i.content").cast("long").alias("n"))


@query("SELECT doc_id, 'data:' || CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END || ';base64,' || to_base64(encode(lang)) AS url FROM documents")
def data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("a/b."), F.element_at(F.array(F.lit("png"), F.lit("JPG"), F.lit("zzz")), (F.col("doc_id") % 3 + 1).cast("int")))
    return _docs(spark, sf_dir).select("doc_id", R.data_url(path, F.encode("lang", "UTF-8")).alias("url"))


@query("SELECT lang AS class, source || '_' || doc_id AS source, 'img' || (row_number() OVER (ORDER BY lang, source || '_' || doc_id) - 1) || '.jpg' AS image FROM documents")
def class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _docs(spark, sf_dir).select(F.concat_ws("/", F.lit("root"), "lang", F.concat_ws("_", "source", "doc_id")).alias("path"))
    return R.class_index(files)


# Filters and projections -------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def filter_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False).alias("is_video"))
    return rows.where(V.not_true("is_video")).drop("is_video")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https://www')")
def filter_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(V.has_prefix("url", "https://www")).select("page_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'None' ELSE '' || n_chars END AS n_text FROM documents")
def cast_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("n", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars"))).select("doc_id", V.as_text("n").alias("n_text"))


@query("SELECT doc_id, 'data/' || lang || '.jpg|data/' || doc_id AS images FROM documents")
def path_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array(F.concat(F.lit("/x/y/"), "lang", F.lit(".jpg")), F.col("doc_id").cast("string"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(V.basenames(paths), "|").alias("images"))


@query("SELECT doc_id, 'dir/' || lang || '|/abs/' || source AS images FROM documents")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(V.under(F.array("lang", F.concat(F.lit("/abs/"), "source")), "dir/"), "|").alias("images"))


@query("SELECT doc_id, lang FROM documents")
def select_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.select_available(_docs(spark, sf_dir), ["doc_id", "bbox", "lang", "image"])


@query("SELECT 'q' || doc_id AS problem, source AS image, CASE WHEN doc_id % 2 = 0 THEN lang ELSE lang || '|' || doc_id END AS solution FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 < 2")
def conv_pixel_reasoner(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    c = F.col
    image = F.when(c("doc_id") % 3 < 2, s("['", c("source"), "']")).otherwise(s("['a', '", c("source"), "']"))
    answer = F.when(c("doc_id") % 2 == 0, s("['\\\\boxed{", c("lang"), "}']")).otherwise(s("[\"\\\\boxed{['", c("lang"), "', ", c("doc_id"), ']}"]'))
    raw = _docs(spark, sf_dir).select(s("q", c("doc_id")).alias("question"), image.alias("image"), answer.alias("answer"), F.when(c("doc_id") % 5 == 0, True).when(c("doc_id") % 5 == 1, False).alias("is_video"))
    out = V.convert(raw, "pixel_reasoner")
    return out.select("problem", F.array_join("image", "|").alias("image"), F.array_join("solution", "|").alias("solution"))


@query("SELECT 'q' || doc_id AS problem, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'a|' || source END AS image, lang AS solution FROM documents")
def conv_vstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    image = F.when(c("doc_id") % 2 == 0, c("source")).otherwise(F.concat(F.lit("['a', '"), "source", F.lit("']")))
    raw = _docs(spark, sf_dir).select(F.concat(F.when(c("doc_id") % 3 == 0, "<image>\n").otherwise(""), F.lit("q"), "doc_id").alias("question"), image.alias("image"), F.concat(F.lit("\\boxed{"), "lang", F.lit("}")).alias("answer"))
    return V.convert(raw, "pixel_reasoner_vstar").withColumn("image", F.array_join("image", "|"))


@query(f"SELECT 'q' || doc_id || E'\\n(A) ' || lang || E'\\n(B) ' || source || E'\\n(C) ' || doc_id || E'\\n(D) None\\n{V.LETTER.replace(chr(39), chr(39) * 2)}' AS problem, source AS image, 'A' AS solution FROM documents")
def conv_hr_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _docs(spark, sf_dir).selectExpr("concat('q', doc_id) AS question", "lang AS A", "source AS B", "doc_id AS C", "CAST(NULL AS STRING) AS D", "source AS image", "'A' AS answer")
    return V.convert(raw, "hr_bench_4k")


@query(f"SELECT 'q' || doc_id || E'\\n' || lang || E'\\n' || source || E'\\n{V.LETTER.replace(chr(39), chr(39) * 2)}' AS problem, source AS image, lang AS solution FROM documents")
def conv_mme(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _docs(spark, sf_dir).selectExpr("concat('q', doc_id) AS question", "array(lang, source) AS `multi-choice options`", "source AS image", "lang AS answer")
    return V.convert(raw, "mme")


@query("SELECT 'q' || doc_id AS problem, source AS image, lang AS solution FROM documents")
def conv_visual_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.convert(_docs(spark, sf_dir).selectExpr("concat('q', doc_id) AS question", "array(source) AS image", "lang AS answer"), "visual_probe_train")


@query(f"SELECT 'q' || doc_id || E'\\n{V.LETTER_IF.replace(chr(39), chr(39) * 2)}' AS problem, source AS image, lang AS solution FROM documents")
def conv_deepeyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.convert(_docs(spark, sf_dir).selectExpr("concat('q', doc_id) AS question", "array(source) AS image", "lang AS answer"), "deepeyes_train_4k")


@query("SELECT doc_id, 2 * (doc_id % 3) + 1 AS n_parts, '\\boxed{' || lang || '}' AS gold, 'Q: q' || doc_id || ' end' AS text FROM (SELECT * FROM documents) WHERE doc_id % 3 < 1 UNION ALL SELECT doc_id, doc_id % 3 + 1, '\\boxed{' || lang || '}', 'Q: q' || doc_id || ' end' FROM documents WHERE doc_id % 3 >= 1")
def make_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("q"), "doc_id").alias("problem"), F.array("lang").alias("solution"), F.array_repeat(F.col("source"), (F.col("doc_id") % 3).cast("int")).alias("image_path"))
    out = V.conversation(rows, "Q: {Question} end")
    content = F.get("prompt", 0)["content"]
    return out.select("doc_id", F.size(content).cast("long").alias("n_parts"), F.get("solution", 0).alias("gold"), F.element_at(content, -1)["text"].alias("text"))


_TASKS = ("rec", "no_think", "pr_adapted", "no_tool", "unknown")


@query("SELECT doc_id, CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{V.template(t).replace('{tool_name}', 'crop_image').replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(_TASKS)) + " END AS prompt FROM documents")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.element_at(F.array(*map(F.lit, _TASKS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", V.name_tools(V.template_column(task), ["crop_image_normalized"]).alias("prompt"))


@query("SELECT doc_id, E'\\nHere is the cropped image (Image Size: ' || n_chars || 'x' || doc_id || '):' AS message FROM documents")
def message_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = V.fill_message(F.lit("\nHere is the cropped image (Image Size: <width>x<height>):"), {"width": F.col("n_chars"), "height": F.col("doc_id")}, ["width", "height"])
    return _docs(spark, sf_dir).select("doc_id", text.alias("message"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'img/' || doc_id ELSE 'data:x' END AS first_url, 'keep' AS second_url FROM documents")
def redact_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind, url: F.struct(kind.alias("type"), F.lit("t").alias("text"), F.lit(url).alias("image_url"))
    parts = F.array(part(F.when(F.col("doc_id") % 2 == 0, "image_url").otherwise("text"), "data:x"), part(F.lit("text"), "keep"))
    out = V.redact_parts(parts, F.concat(F.lit("img/"), "doc_id"))
    return _docs(spark, sf_dir).select("doc_id", F.get(out, 0)["image_url"].alias("first_url"), F.get(out, 1)["image_url"].alias("second_url"))


@query("SELECT 'zoom_in' AS name, 'integer' AS item_type, 'bbox_2d,target_image' AS required")
def tool_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = V.customize(V.ZOOM_SCHEMA, {"function,parameters,properties,bbox_2d,items,type": "integer"})
    j = spark.range(1).select(F.lit(json.dumps(tool)).alias("j"))
    required = F.from_json(F.get_json_object("j", "$.function.parameters.required"), "array<string>")
    return j.select(F.get_json_object("j", "$.function.name").alias("name"), F.get_json_object("j", "$.function.parameters.properties.bbox_2d.items.type").alias("item_type"), F.array_join(required, ",").alias("required"))


# Joins -------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_custkey * 2 AS answer FROM orders")
def zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    right = left.select(F.col("o_orderkey").alias("k"), "o_custkey", (F.col("o_custkey") * 2).alias("answer"))
    return V.zip_join(left, right, "o_custkey", "o_orderkey", "k", ["answer"])


@query("SELECT n_nationkey, unnest([0, 1, 2])::INT AS pos, unnest([n_name, 'b', 'c']) AS name, unnest([n_regionkey, 8, 9]) AS v FROM nation")
def zip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.array("n_name", F.lit("b"), F.lit("c")).alias("name"), F.array("n_regionkey", F.lit(8), F.lit(9)).alias("v"))
    return P.zip_lists(rows, "name", "v")


@query("SELECT short, tool, px, padding FROM (VALUES ('m')) a(short), (VALUES ('zoom_in'), ('no_tool')) b(tool), (VALUES (1024), (2048), (4096)) c(px), (VALUES (0.1::DOUBLE), (0.0)) d(padding)")
def config_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.product(spark, {"short": "m", "tool": ["zoom_in", "no_tool"], "px": [1024, 2048, 4096], "padding": [0.1, 0.0]})


def _datasets(spark: SparkSession) -> DataFrame:
    schema = "name string, path string, grid_pixels array<int>, gridsize array<int>, mode array<string>"
    return spark.createDataFrame([("muffin_chihuahua", "/g", [1, 2], [1, 4], ["single_cell_query", "find_outlier"]), ("hr_bench_4k", "/h", None, None, None), ("other", "/o", None, None, None)], schema)


_UNPACKED = """u AS (SELECT 'muffin_chihuahua_grid_pixels_' || k * 1024 || '_gridsize_' || g || '_samples_class_0_' || CASE WHEN m = 'find_outlier' THEN 1 ELSE greatest(1, g * g // 2) END AS dataset_name, k || 'k_' || g || CASE WHEN m = 'find_outlier' THEN '_fo' ELSE '_scq' END AS short, '/g' AS dataset_path
  FROM (VALUES (1), (2)) a(k), (VALUES (1), (4)) b(g), (VALUES ('single_cell_query'), ('find_outlier')) c(m) WHERE NOT (g = 1 AND m = 'find_outlier') UNION ALL SELECT 'hr_bench_4k', 'hrb_4k', '/h' UNION ALL SELECT 'other', 'other', '/o')"""


@query(f"WITH {_UNPACKED} SELECT * FROM u")
def dataset_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unpack_datasets(_datasets(spark))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'pr' WHEN 1 THEN 'V*' ELSE n_name END AS short FROM nation")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 3 == 0, "pixel_reasoner").when(F.col("n_nationkey") % 3 == 1, "pixel_reasoner_vstar").otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", P.short_name(name).alias("short"))


_EVALS = f"""{_UNPACKED}, e AS (SELECT dataset_name, dataset_path, tool, t, 'm_' || dataset_name || '_' || tool || '_12845056_3136_0.1' || CASE WHEN t > 0 THEN '_0.7_4' ELSE '' END AS name FROM u, (VALUES ('zoom_in'), ('no_tool')) b(tool), (VALUES (0.0), (0.7)) c(t))"""


def _evals(spark: SparkSession) -> DataFrame:
    rows = P.unpack_datasets(_datasets(spark)).crossJoin(F.broadcast(P.product(spark, {"tool": ["zoom_in", "no_tool"], "t": [0.0, 0.7]})))
    return rows.withColumn("name", P.eval_name(F.lit("m"), F.col("dataset_name"), F.col("tool"), F.lit(12845056), F.lit(3136), F.lit(0.1), F.col("t"), F.lit(4)))


@query(f"WITH {_EVALS} SELECT name, '/out/eval/dataset_' || dataset_name || '_prompt_' || tool || '_max_pixels_12845056_min_pixels_3136_padding_0.1' || CASE WHEN t > 0 THEN '_temp_0.7_samples_4' ELSE '' END AS path FROM e")
def k_eval_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.save_path(F.lit("/out"), F.lit("eval"), F.col("dataset_name"), F.col("tool"), F.lit(12845056), F.lit(3136), F.lit(0.1), F.col("t"), F.lit(4))
    return _evals(spark).select("name", path.alias("path"))


@query(f"""
WITH {_UNPACKED}, t AS (SELECT *, starts_with(dataset_name, 'muffin_chihuahua') AS g, CASE WHEN ends_with(dataset_name, 'class_0_1') AND NOT contains(dataset_name, 'gridsize_1_') THEN 'find_outlier' ELSE 'single_cell_query' END AS task FROM u)
SELECT dataset_name, CASE WHEN g THEN task END AS task, CASE WHEN g THEN '/g/' || substr(dataset_name, 18) || '/' || task || '.jsonl' ELSE dataset_path || '/test.jsonl' END AS data_files, CASE WHEN g THEN '/g/' || substr(dataset_name, 18) || '/images' ELSE dataset_path END AS image_folders FROM t""")
def k_dataset_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unpack_datasets(_datasets(spark)).select("dataset_name", P.dataset_params(F.col("dataset_name"), F.col("dataset_path")).alias("p")).select("dataset_name", "p.*")


_NAMES = ["m_other_no_tool_12845056_3136_0.1_0.7_4", "m_hr_bench_4k_zoom_in_12845056_3136_0.1", "m_other_zoom_in_12845056_3136_0.1"]


@query(f"WITH {_EVALS} SELECT name FROM e WHERE name IN ('{_NAMES[0]}', '{_NAMES[1]}', '{_NAMES[2]}') AND tool = 'zoom_in' AND dataset_path = '/o'")
def eval_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.choose(_evals(spark), "name", _NAMES, {"tool": "zoom_in", "dataset_path": "/o"}).select("name")


@query(f"WITH {_EVALS} SELECT name, list_position(['{_NAMES[0]}', '{_NAMES[1]}', '{_NAMES[2]}'], name)::INT - 1 AS pos FROM e WHERE name IN ('{_NAMES[0]}', '{_NAMES[1]}', '{_NAMES[2]}')")
def eval_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.in_order(_evals(spark), "name", _NAMES).select("name", "pos").orderBy("pos")


# Generation --------------------------------------------------------------

_CONFIGS = "g AS (SELECT s AS big_image_size, n AS grid_size, unnest(CASE WHEN n > 1 THEN [1, n * n // 2] ELSE [1] END)::INT AS num_samples_class_0 FROM (VALUES (1024), (2048), (4096), (8192)) a(s), (VALUES (1), (2), (4), (8), (16)) b(n))"


@query(f"WITH {_CONFIGS} SELECT * FROM g")
def grid_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.grid_configs(spark)


@query("""
WITH RECURSIVE h AS (SELECT n_nationkey, sha256(n_name) AS h FROM nation), d AS (SELECT n_nationkey, h, 0 AS i, 0::BIGINT AS v FROM h UNION ALL SELECT n_nationkey, h, i + 1, (v * 16 + ('0x' || substr(h, i + 1, 1))::BIGINT) % 1000000 FROM d WHERE i < 64)
SELECT n_nationkey, 42 + v AS seed FROM d WHERE i = 64""")
def k_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", N.seed_of(42, F.col("n_name")).alias("seed"))


def _draw(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / {float(16**13)})"


_CELLS = f"""{_CONFIGS}, x AS (SELECT *, big_image_size || '_' || grid_size || '_' || num_samples_class_0 AS config FROM g),
y AS (SELECT x.*, img, unnest(range(grid_size * grid_size)) AS cell FROM x, range(100) r(img)), z AS (SELECT *, {_draw('42', "config || ':' || img || ':' || cell")} AS d FROM y),
c AS (SELECT *, CASE WHEN grid_size = 1 THEN (img < 50)::INT ELSE (row_number() OVER (PARTITION BY config, img ORDER BY d, cell) > num_samples_class_0)::INT END AS label FROM z)"""


def _cells(spark: SparkSession) -> DataFrame:
    """All configurations, a hundred images each."""
    return N.cells(N.grid_configs(spark), 100)


@query(f"""
WITH {_CELLS}, f AS (SELECT p_partkey % 2 AS label, 'img' || p_partkey || '.jpg' AS image FROM part), n AS (SELECT label, image, row_number() OVER (PARTITION BY label ORDER BY image) - 1 AS n FROM f), s AS (SELECT label, count(*) AS size FROM f GROUP BY label),
k AS (SELECT config, img, cell, c.label, floor({_draw('42f', "config || ':' || img || ':' || cell")} * size)::BIGINT AS n FROM c JOIN s ON s.label = c.label)
SELECT config, img, cell, k.label, image FROM k JOIN n ON n.label = k.label AND n.n = k.n""")
def gen_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with its label and the file that is shown in it."""
    files = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).cast("int").alias("label"), F.concat(F.lit("img"), "p_partkey", F.lit(".jpg")).alias("image"))
    return N.files_for(_cells(spark), files).select("config", "img", "cell", "label", "image")


@query(f"""
WITH {_CELLS}, w AS (SELECT *, {_draw('42q', "config || ':' || img || ':' || cell")} AS q FROM c WHERE (num_samples_class_0 <> 1 OR grid_size = 1) AND label = CASE WHEN grid_size = 1 THEN label ELSE (img >= 50)::INT END),
p AS (SELECT config, img, grid_size, big_image_size, arg_min(cell, q) AS cell, arg_min(label, q) AS label FROM w GROUP BY ALL), o AS (SELECT *, {_draw('42o', "config || ':' || img")} > 0.5 AS f FROM p)
SELECT config, img, 'single' AS kind, '{N.PREAMBLE.replace("'", "''")}Which object is in cell number ' || cell || E'?\n(A) ' || CASE WHEN f THEN 'Muffin' ELSE 'Chihuahua' END || E'\n(B) ' || CASE WHEN f THEN 'Chihuahua' ELSE 'Muffin' END || E'\nAnswer with the option''s letter from the given choices directly.' AS problem,
  CASE WHEN f = (label = 0) THEN 'A' ELSE 'B' END AS solution, (cell % grid_size * (big_image_size // grid_size))::INT AS x1 FROM o
UNION ALL SELECT config, img, 'outlier', E'{(N.PREAMBLE + N.OUTLIER).replace("'", "''").replace(chr(10), chr(92) + "n")}', '' || cell, (cell % grid_size * (big_image_size // grid_size))::INT FROM c WHERE num_samples_class_0 = 1 AND grid_size > 1 AND label = 0""")
def gen_vqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark)
    one, out = N.single_cell_queries(c, 100).withColumn("kind", F.lit("single")), N.outlier_queries(c).withColumn("kind", F.lit("outlier"))
    return one.unionByName(out).select("config", "img", "kind", "problem", "solution", F.col("bbox.x1").cast("int").alias("x1"))


def _u(name: str) -> str:
    return f"(('0x' || substr(md5('0{name}:' || k || ':' || attempt), 1, 13))::BIGINT / {float(16**13)})"


def _normal(a: str, b: str) -> str:
    return f"(sqrt(-2 * ln(greatest({_u(a)}, 1e-12))) * cos(2 * pi() * {_u(b)}))"


_REFS = "refs AS (SELECT o_orderkey AS k, (o_custkey % 300 + 50)::INT AS px, (o_orderkey % 200 + 40)::INT AS py FROM orders)"


def _tried(name: str, rows: str, first: int, last: int) -> str:
    """Candidates of attempts ``first`` to ``last`` of the boxes in ``rows``, as the last of several tables."""
    t = lambda i: f"{name}{i}"
    return f"""
{t(1)} AS (SELECT k, px, py, unnest(range({first}, {last + 1}))::INT AS attempt FROM {rows}),
{t(2)} AS (SELECT *, least(greatest(1.0::DOUBLE, round_even(30000.0::DOUBLE * exp({_normal("a", "b")} * {0.9 * (1 - 0.3) + 0.08}::DOUBLE), 0)), 800000.0::DOUBLE) AS area, exp({_normal("c", "d")} * 0.55::DOUBLE) AS aspect FROM {t(1)}),
{t(3)} AS (SELECT *, greatest(2, least(1000, round_even(sqrt(area * aspect), 0)::INT)) AS w2, greatest(2, least(800, round_even(sqrt(area / aspect), 0)::INT)) AS h2 FROM {t(2)}),
{t(4)} AS (SELECT *, greatest(0.0::DOUBLE, least(30000.0::DOUBLE, w2 * h2, 0.3::DOUBLE * (30000.0::DOUBLE + w2 * h2) / 1.3::DOUBLE)) AS need, greatest(1, round_even((0.15::DOUBLE + 0.85::DOUBLE * {_u("o")}) * least(200, w2), 0)::INT) AS ow FROM {t(3)}),
{t(5)} AS (SELECT *, round_even(need / ow, 0)::INT AS oh FROM {t(4)}),
{t(6)} AS (SELECT *, round_even((px + px + 200) / 2.0::DOUBLE + greatest(0, round_even((200 + w2) / 2.0::DOUBLE - ow, 0)::INT) * CASE WHEN {_u("e")} < 0.5 THEN -1 ELSE 1 END - w2 / 2.0::DOUBLE, 0)::INT AS x1,
  round_even((py + py + 150) / 2.0::DOUBLE + greatest(0, round_even((150 + h2) / 2.0::DOUBLE - oh, 0)::INT) * CASE WHEN {_u("f")} < 0.5 THEN -1 ELSE 1 END - h2 / 2.0::DOUBLE, 0)::INT AS y1 FROM {t(5)}),
{name} AS (SELECT k, px, py, attempt, x1, y1, x1 + w2 AS x2, y1 + h2 AS y2 FROM {t(6)} WHERE oh >= 1 AND oh <= least(150, h2) AND x1 >= 0 AND y1 >= 0 AND x1 + w2 <= 1000 AND y1 + h2 <= 800)"""


@query(f"WITH {_REFS}, {_tried('c', 'refs', 0, 7)} SELECT k, attempt, x1, y1, x2, y2 FROM c")
def b_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.candidates(_refs(spark, sf_dir), "k", "ref", "w", "h", 0.3, 8).select("k", "attempt", "cand.*")


def _shared(px: str) -> str:
    """Overlap of a candidate with the reference box laid at px, over their union."""
    inside = f"(greatest(0, least({px} + 200, x2) - greatest({px}, x1)) * greatest(0, least(py + 150, y2) - greatest(py, y1)))"
    return f"({inside}::DOUBLE / (30000 + (x2 - x1) * (y2 - y1) - {inside}))"


def _judged(name: str) -> str:
    """The best candidate of each box so far: within tolerance, digits kept, nearest, first."""
    digits = " OR ".join(f"length('' || {a}) <> length('' || ({b}))" for a, b in (("x1", "px"), ("y1", "py"), ("x2", "px + 200"), ("y2", "py + 150")))
    return f"""
{name}e AS (SELECT *, abs({_shared("px")} - 0.3::DOUBLE) AS error, {_shared("(px + 120)")} > 0.05::DOUBLE AS near, {digits} AS digits FROM {name}),
{name}o AS (SELECT *, error <= 0.05::DOUBLE AND NOT near AS ok FROM {name}e),
{name}b AS (SELECT k, px, py, min({{'o': (NOT ok)::INT, 'd': (ok AND digits)::INT, 'e': CASE WHEN ok THEN 0.0::DOUBLE ELSE error END, 't': attempt, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'error': error}}) AS b FROM {name}o GROUP BY k, px, py)"""


@query(f"""
WITH {_REFS}, {_tried("p", "refs", 0, 63)}, {_judged("p")}, more AS (SELECT r.* FROM refs r LEFT JOIN pb USING (k) WHERE b IS NULL OR b.o > 0 OR b.d > 0),
{_tried("q", "more", 0, 4999)}, {_judged("q")}, best AS (SELECT k, b FROM pb WHERE b.o = 0 AND b.d = 0 UNION ALL SELECT k, b FROM qb)
SELECT r.k, b.x1, b.y1, b.x2, b.y2, round(b.error, 6) AS error FROM refs r LEFT JOIN best USING (k)""")
def b_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Away from an earlier box, which lies 120 pixels to the right of the reference box."""
    from tessera.functions import geometry as G

    rows = _refs(spark, sf_dir).withColumn("others", F.array(G.shift(F.col("ref"), F.lit(120), F.lit(0))))
    return N.negative_boxes(rows, "k", "ref", "w", "h", 0.3, others="others").select("k", "bbox.*", F.round("error", 6).alias("error"))


@query(f"""
WITH {_REFS}, t AS (SELECT k, px, py, unnest(range(400))::INT AS attempt FROM refs WHERE k % 10 <> 0),
s AS (SELECT *, 28 + floor({_u("w")} * 573)::INT AS w2, 28 + floor({_u("h")} * 453)::INT AS h2, {_u("x")} AS ux, {_u("y")} AS uy FROM t),
p AS (SELECT k, px, py, attempt, floor(ux * (1001 - w2))::INT AS x1, floor(uy * (801 - h2))::INT AS y1, floor(ux * (1001 - w2))::INT + w2 AS x2, floor(uy * (801 - h2))::INT + h2 AS y2 FROM s),
e AS (SELECT *, {_shared("px")} AS error, length('' || px) <> length('' || x1) OR length('' || py) <> length('' || y1) OR length('' || (px + 200)) <> length('' || x2) OR length('' || (py + 150)) <> length('' || y2) AS digits FROM p),
b AS (SELECT k, min({{'o': (error > 0)::INT, 'd': (error = 0 AND digits)::INT, 'e': error, 't': attempt, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) AS b FROM e GROUP BY k),
w AS (SELECT k, floor({_u("x")} * 973)::INT AS x1, floor({_u("y")} * 773)::INT AS y1 FROM (SELECT k, 0 AS attempt FROM refs WHERE k % 10 = 0))
SELECT k, b.x1, b.y1, b.x2, b.y2, round(b.e, 6) AS error FROM b UNION ALL SELECT k, x1, y1, x1 + 28, y1 + 28, round(784 / 800000.0::DOUBLE, 6) FROM w""")
def b_negative_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that do not overlap the reference box; every tenth of these is the whole image."""
    from tessera.functions import geometry as G

    whole = G.box(F.lit(0), F.lit(0), F.col("w"), F.col("h"))
    rows = _refs(spark, sf_dir).withColumn("ref", F.when(F.col("k") % 10 == 0, whole).otherwise(F.col("ref")))
    return N.negative_boxes(rows, "k", "ref", "w", "h", 0.0, max_tries=400).select("k", "bbox.*", F.round("error", 6).alias("error"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions import geometry as G

    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CAST(o_custkey % 300 + 50 AS INT) x", "CAST(o_orderkey % 200 + 40 AS INT) y", "1000 AS w", "800 AS h")
    return o.select("k", "w", "h", G.box(F.col("x"), F.col("y"), F.col("x") + 200, F.col("y") + 150).alias("ref"))
