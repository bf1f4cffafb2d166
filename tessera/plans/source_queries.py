"""Readers and writers, each driven through files of its format in the shared folder."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.pinned import scratch
from tessera.plans.registry import Registry, table
from tessera.sources import datasets as D
from tessera.sources import mirrors as X
from tessera.sources import readers as R
from tessera.sources import units as U

registry = Registry()
query = registry.query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT n_nationkey, n_name FROM nation")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scan(spark, f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey % 3 < 2")
def scan_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards are written, and the first two of them read."""
    root = scratch(spark, "shards")
    for i in range(3):
        table(spark, sf_dir, "region").where(F.col("r_regionkey") % 3 == i).write.parquet(f"{root}/region-{i:02d}-of-03.parquet")
    return R.scan_sharded(spark, root + "/region-{i:02d}-of-{n:02d}.parquet", 3, max_shards=2).select("r_regionkey", "r_name")


@query("SELECT n_nationkey AS id, n_name AS problem, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS answer FROM nation")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array in one file."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("problem"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("answer"))
    path = scratch(spark, "nations") + ".json"
    array = R.to_json_lines(rows).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))  # one small table
    array.write.text(path)
    return R.scan(spark, path, schema=rows.schema)


@query("SELECT doc_id, lang AS problem, source AS solution, text FROM documents")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of whole texts, written and read."""
    path = scratch(spark, "documents") + ".jsonl"
    R.write_json_lines(_docs(spark, sf_dir).selectExpr("doc_id", "lang AS problem", "source AS solution", "text"), path)
    return R.scan(spark, path, schema="doc_id bigint, problem string, solution string, text string")


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","score":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '' || doc_id % 7 END || '}' AS line FROM documents""")
def to_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard written, another appended."""
    rows, path = _docs(spark, sf_dir).selectExpr("doc_id", "lang", "CASE WHEN doc_id % 2 = 1 THEN doc_id % 7 END AS score"), scratch(spark, "lines") + ".jsonl"
    R.write_json_lines(rows.where("doc_id % 2 = 0"), path)
    R.write_json_lines(rows.where("doc_id % 2 = 1"), path, append=True)
    return spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("value").alias("line"))


@query("""
SELECT problem, array_to_string(image_path, '|') AS images, array_to_string(solution, '|') AS solutions, accu_reward_method, dataset FROM (
  SELECT 'q' || doc_id AS problem, CASE WHEN doc_id % 3 = 0 THEN ['imgs/a', 'imgs/' || source] WHEN doc_id % 3 = 1 THEN ['imgs/' || source] ELSE ['/abs/' || source] END AS image_path, CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE ['' || doc_id] END AS solution, 'default' AS accu_reward_method, 'docs' AS dataset FROM documents WHERE doc_id % 5 > 0
  UNION ALL SELECT 'p' || page_id, ['pages/' || page_id || '.png'], ['x', 'y'], 'mcq', 'pages' FROM pages)""")
def canonical_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpora of JSON lines, one with blank lines, read as one canonical table."""
    image = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('["a","'), "source", F.lit('"]'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"'), "source", F.lit('"'))).otherwise(F.concat(F.lit('"/abs/'), "source", F.lit('"')))
    gold = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('["'), "lang", F.lit('"]'))).otherwise(F.col("doc_id").cast("string"))
    line = F.concat(F.lit('{"problem":"q'), "doc_id", F.lit('","image":'), image, F.lit(',"solution":'), gold, F.lit("}"))
    docs = _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(line).alias("value"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit('{"problem":"p'), "page_id", F.lit('","image":"'), "page_id", F.lit('.png","solution":["x","y"]}')).alias("value"))
    files = [scratch(spark, name) + ".jsonl" for name in ("docs", "pages")]
    for rows, file in zip((docs, pages), files):
        rows.write.text(file)
    both = R.canonical(spark, ["docs", "pages"], files, ["imgs", "pages"], "default:mcq")
    return both.select("problem", F.array_join("image_path", "|").alias("images"), F.array_join("solution", "|").alias("solutions"), "accu_reward_method", "dataset")


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS sample_id, r_regionkey AS k, r_name AS name FROM region")
def result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A columnar result file, written and read as rows; one that is missing and one that is no JSON give None."""
    root = scratch(spark, "results")
    wide = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("a"))
    wide.select(F.to_json(F.struct(F.col("a.r_regionkey").alias("k"), F.col("a.r_name").alias("name"))).alias("value")).write.text(f"{root}/good.json")
    spark.range(1).select(F.lit("{not json").alias("value")).write.text(f"{root}/bad.json")
    if R.results(spark, f"{root}/none.json") is not None or R.results(spark, f"{root}/bad.json") is not None:
        raise AssertionError("a missing or undecodable result file must give None")
    kind = table(spark, sf_dir, "region").schema["r_regionkey"].dataType
    return R.results(spark, f"{root}/good.json").select("sample_id", F.col("k").cast(kind).alias("k"), "name")


@query("SELECT o_orderpriority AS name, count(*) AS n, max(o_custkey) / 8.0::DOUBLE AS score FROM orders GROUP BY o_orderpriority")
def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table written as comma-separated values, and read with its header."""
    path = scratch(spark, "table")
    R.write_table(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"), (F.max("o_custkey") / 8.0).alias("score")), path)
    return spark.read.option("header", "true").schema("name string, n bigint, score double").csv(path)


@query("SELECT n_nationkey AS k, n_name || '.txt' AS member, 'text of ' || n_name AS content FROM nation UNION ALL SELECT n_nationkey, 'sub/b.txt', 'b' FROM nation")
def unzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive for each nation, with a folder in it, packed and unpacked."""

    @F.pandas_udf("binary")
    def pack(name: pd.Series) -> pd.Series:
        def one(n: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(f"{n}.txt", f"text of {n}")
                z.writestr("sub/", "")
                z.writestr("sub/b.txt", "b")
            return out.getvalue()

        return name.map(one)

    nation = table(spark, sf_dir, "nation")
    archives = nation.select(F.col("n_nationkey").cast("string").alias("path"), pack("n_name").alias("content"))
    return R.unzip(archives).select(F.col("path").cast(nation.schema["n_nationkey"].dataType).alias("k"), "member", F.decode("content", "UTF-8").alias("content"))


@query("SELECT n_nationkey, n_regionkey * 10 AS made, n_nationkey < 10 AS first_run FROM nation")
def resume_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that made some configurations, and one that makes the rest."""
    wanted, path = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), scratch(spark, "generated")
    make = lambda first: lambda todo: todo.select("n_nationkey", (F.col("n_regionkey") * 10).alias("made"), F.lit(first).alias("first_run"))
    R.resume(wanted.where("n_nationkey < 10"), path, ["n_nationkey"], make(True))
    return R.resume(wanted, path, ["n_nationkey"], make(False))


@query("SELECT n_nationkey, n_regionkey + CASE WHEN n_regionkey < 2 THEN 0 ELSE 100 END AS v, n_regionkey < 2 AS skipped FROM nation")
def exist_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that are there already: skipped for two regions, overwritten for the others."""
    rows, parts = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), []
    for skip in (True, False):
        path = scratch(spark, "output")
        part = rows.where(f"n_regionkey {'<' if skip else '>='} 2")
        R.write_output(part.select("n_nationkey", F.col("n_regionkey").alias("v")), path)
        written = R.write_output(part.select("n_nationkey", (F.col("n_regionkey") + 100).alias("v")), path, "skip" if skip else "overwrite")
        parts.append(spark.read.parquet(path).withColumn("skipped", F.lit(not written)))
    return parts[0].unionByName(parts[1])


@query("""
SELECT 'unit ' || n_regionkey || '/é' AS unit, count(*) AS n, count(*) AS marked, sum(n_nationkey)::BIGINT AS keys, 0::BIGINT AS after_failure, n_regionkey = 0 AS first FROM nation GROUP BY n_regionkey""")
def unit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that fails on one unit's last row leaves no marker; then one unit is written, then those that are missing."""
    unit = F.concat(F.lit("unit "), F.col("n_regionkey"), F.lit("/é"))
    rows, path = table(spark, sf_dir, "nation").select(unit.alias("unit"), "n_nationkey", "n_name").repartition(4, "n_nationkey"), scratch(spark, "units")
    broken = rows.withColumn("n_name", F.when((F.col("unit") == "unit 3/é") & (F.col("n_nationkey") > 20), F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("n_name")))
    try:
        U.write_units(broken, path, "unit")
        raise AssertionError("the broken job has ended well")
    except PySparkException:
        after = U.done_units(spark, path).count()
    U.write_units(rows.where("unit = 'unit 0/é'"), path, "unit")
    first = U.done_units(spark, path).select("unit", F.lit(True).alias("first"))
    U.write_missing(rows, path, "unit")
    back = U.read_units(spark, path, "unit string, n_nationkey long, n_name string").groupBy("unit").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))
    marked = U.done_units(spark, path).select("unit", F.col("rows").alias("marked"))
    return back.join(marked, "unit").join(first, "unit", "left").select("unit", "n", "marked", "keys", F.lit(after).cast("long").alias("after_failure"), F.coalesce("first", F.lit(False)).alias("first"))


@query("""
SELECT 'hr_bench_4k' AS dataset, count(*) AS n, min(source) AS image, min(lang) AS solution FROM (SELECT source, 'A' AS lang FROM documents)
UNION ALL SELECT 'mme_lite', count(*), min(source), min(lang) FROM documents WHERE doc_id % 4 < 3
UNION ALL SELECT 'visual_probe_train', count(*), 'root/data/' || min(source), min(lang) FROM documents""")
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset of each layout, from files made of the documents; of the sharded one three of four shards."""
    docs, root = table(spark, sf_dir, "documents"), scratch(spark, "datasets")
    docs.selectExpr("concat('q', doc_id) AS question", "lang AS A", "source AS B", "doc_id AS C", "CAST(NULL AS STRING) AS D", "source AS image", "'A' AS answer").write.parquet(f"{root}/hr/images.parquet")
    for i in range(D.KNOWN["mme_lite"].shards):
        part = docs.where(F.col("doc_id") % 4 == i)
        part.selectExpr("concat('q', doc_id) AS question", "array(lang, source) AS `multi-choice options`", "source AS image", "lang AS answer").write.parquet(f"{root}/mme/images_{i}.parquet")
        part.selectExpr("concat('q', doc_id) AS question", "array(source) AS image", "lang AS answer").agg(F.to_json(F.collect_list(F.struct("question", "image", "answer")))).coalesce(1).write.mode("append").text(f"{root}/probe/train.json")
    out = None
    for name, folder in (("hr_bench_4k", "hr"), ("mme_lite", "mme"), ("visual_probe_train", "probe")):
        schema = "question string, image array<string>, answer string" if folder == "probe" else None
        rows = D.load(spark, name, f"{root}/{folder}", 3, schema)
        image, solution = (F.get(c, 0) if rows.schema[c].dataType.typeName() == "array" else F.col(c) for c in ("image", "solution"))
        part = rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("n"), F.min(image).alias("image"), F.min(solution).alias("solution"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("image", F.replace("image", F.lit(f"{root}/probe"), F.lit("root")))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
SELECT page_id, CASE WHEN page_id % 11 <> 0 THEN sha256(html) END AS name, CASE WHEN page_id % 11 <> 0 THEN strlen(html) END::BIGINT AS size,
  CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 0 ELSE 1 END::INT AS mirror, CASE WHEN page_id % 2 = 0 AND page_id % 11 <> 0 THEN 1 ELSE 2 END::INT AS call, page_id % 11 = 0 AS failed FROM p""")
def fetch_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from two mirrors, the first of which has every third file and neither every eleventh: the even ones, then all that are missing."""
    root = scratch(spark, "mirrors")
    system, folder = U._at(root)
    for name in ("a", "b"):
        system.create_dir(f"{folder}/{name}")

    def put(batches):
        for batch in batches:
            for i, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                for name in (("a", "b") if i % 3 == 0 else ("b",)) if i % 11 else ():
                    with U._at(root)[0].open_output_stream(f"{folder}/{name}/{i}.html") as out:
                        out.write((html or "").encode())
            yield batch.select(["page_id"])

    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    pages.mapInArrow(put, "page_id long").write.format("noop").mode("overwrite").save()
    places = F.array(*(F.concat(F.lit(f"{root}/{name}/"), "page_id", F.lit(".html")) for name in ("a", "b")))
    rows = pages.select("page_id", places.alias("urls"))
    # Of the even pages those that fail are tried again by the second call, whose outcome counts.
    first = X.fetch(rows.where("page_id % 2 = 0"), "page_id", "urls", f"{root}/out").where("error is null").withColumn("call", F.lit(1))
    second = X.fetch(rows, "page_id", "urls", f"{root}/out").withColumn("call", F.lit(2))
    return first.unionByName(second).select(F.col("key").cast("long").alias("page_id"), "name", "size", "mirror", "call", F.col("error").isNotNull().alias("failed"))
