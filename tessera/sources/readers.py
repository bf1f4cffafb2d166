"""Readers and writers of the data model's files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import convert
from tessera.operators.numbering import numbered

#: Columns every canonical record must have.
REQUIRED = ("problem", "image", "solution")
FORMATS = ("parquet", "json", "jsonl")


class UnknownFormat(ValueError):
    """The file's format is none that can be read."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, a JSON array, or JSON lines, by ``fmt`` or the path's suffix."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1]
    if fmt not in FORMATS:
        raise UnknownFormat(f"unknown format {fmt!r} of {path}; choose from {FORMATS}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("multiLine", str(fmt == "json").lower()).json(path)


def scan_sharded(spark: SparkSession, template: str, n_shards: int, max_shards: int | None = None) -> DataFrame:
    """Parquet shards 0 .. n-1 of a path template with ``i`` and ``n``, the first ``max_shards`` only."""
    take = n_shards if max_shards is None else min(max_shards, n_shards)
    return spark.read.parquet(*(template.format(i=i, n=n_shards) for i in range(take)))


def listed(value: Column) -> Column:
    """A JSON value that is a scalar or a list, as an array of texts."""
    scalar = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), value)
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(scalar))


def canonical(spark: SparkSession, names: list[str], files: list[str], folders: list[str], reward_method: str | None = None, extras: str = "bbox array<int>") -> DataFrame:
    """Canonical JSON-lines corpora as one table, tagged with their scoring method.

    Blank lines are skipped; a record without a required key raises; scalar
    images and solutions become lists; relative images are put under the
    corpus' folder. ``extras`` declares further keys to keep.
    """
    if len(files) != len(folders):
        raise ValueError("the numbers of data files and image folders differ")
    methods = ["default"] * len(files) if reward_method is None else reward_method.split(":")
    if len(methods) != len(files):
        raise ValueError("the numbers of reward methods and data files differ")
    out: DataFrame | None = None
    for name, file, folder, method in zip(names, files, folders, methods):
        part = records(spark.read.text(file), folder, method, extras).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no data files")
    return out


def records(lines: DataFrame, folder: str, method: str = "default", extras: str = "bbox array<int>") -> DataFrame:
    """JSON lines (column ``value``) as canonical rows."""
    text = lines.where(F.length(F.trim("value")) > 0)
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*(F.lit(k) for k in REQUIRED)), F.coalesce(keys, F.array().cast("array<string>")))
    checked = text.withColumn("value", F.when(F.size(missing) == 0, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("record is missing required keys "), F.array_join(missing, ", ")))))
    # A string field of the schema keeps lists and numbers as their JSON text.
    schema = f"problem string, image string, solution string{', ' + extras if extras else ''}"
    row = checked.select(F.from_json("value", schema).alias("r")).select("r.*")
    others = [c for c in row.columns if c not in REQUIRED]
    return row.select("problem", convert.under(listed(F.col("image")), folder).alias("image_path"), listed(F.col("solution")).alias("solution"), *others, F.lit(method).alias("accu_reward_method"))


def to_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row (column ``value``), NULL fields written."""
    return rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with unescaped Unicode; the committer's marker says when they are complete."""
    to_json_lines(rows).write.mode("append" if append else "overwrite").text(path)


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """A columnar result file as rows ``sample_id`` + one value per metric list; None if missing or undecodable."""
    if not _exists(spark, path):
        return None
    raw = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    if raw.columns == ["_corrupt_record"] or not raw.columns:
        return None
    arrays = [f.name for f in raw.schema if isinstance(f.dataType, T.ArrayType) and f.name != "_corrupt_record"]
    zipped = raw.select(F.posexplode(F.arrays_zip(*(F.col(f"`{c}`") for c in arrays))).alias("sample_id", "r"))
    return zipped.select("sample_id", "r.*")


def write_table(table: DataFrame, path: str) -> None:
    """Result table as comma-separated values with a header."""
    table.write.mode("overwrite").option("header", "true").csv(path)


def class_index(files: DataFrame, path: str = "path") -> DataFrame:
    """(class, source, image): files numbered by class and name, class being the parent folder."""
    parts = F.split(F.col(path), "/")
    named = files.select(F.element_at(parts, -2).alias("class"), F.element_at(parts, -1).alias("source"))
    return numbered(named, "class", "source").select("class", "source", F.concat(F.lit("img"), F.col("rn") - 1, F.lit(".jpg")).alias("image"))


def unfinished(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Configurations without an output yet, for resumed runs."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resume(wanted: DataFrame, path: str, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Outputs of all wanted configurations under ``path``; only those without one are made, and appended.

    A run that was lost has committed nothing, so it is made again.
    """
    spark = wanted.sparkSession
    todo = unfinished(wanted, spark.read.parquet(path), *keys) if _exists(spark, f"{path}/_SUCCESS") else wanted
    make(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_output(rows: DataFrame, path: str, exist: str = "raise") -> bool:
    """Write an evaluation's output; where it exists already, raise, overwrite or skip. Says whether it was written."""
    if exist not in ("raise", "overwrite", "skip"):
        raise ValueError(f"unknown exist behaviour {exist!r}")
    if _exists(rows.sparkSession, path):
        if exist == "raise":
            raise FileExistsError(path)
        if exist == "skip":
            return False
    rows.write.mode("overwrite").parquet(path)
    return True


def unzip(archives: DataFrame, member_schema: str = "path string, member string, content binary") -> DataFrame:
    """Members of zip archives (columns ``path``, ``content`` as the binary-file source gives them); folders are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([z.read(name)], pa.binary())], schema=schema)

    return archives.select("path", "content").mapInArrow(run, member_schema)


# MIME types by suffix.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "mp4": "video/mp4", "json": "application/json", "txt": "text/plain", "html": "text/html"}


def data_url(path: Column, content: Column) -> Column:
    """A file's content as a data URL, its type guessed from the suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit("application/octet-stream")
    for s, m in MIME.items():
        kind = F.when(suffix == s, m).otherwise(kind)
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def decode_image(b64: Column) -> Column:
    """(content, name): bytes of a base64 text, and a name from their digest."""
    raw = F.unbase64(b64)
    return F.struct(raw.alias("content"), F.concat(F.sha2(raw, 256), F.lit(".jpg")).alias("name"))


#: How each known dataset is laid out at its source.
DATASETS = {
    "pixel_reasoner": "parquet",
    "pixel_reasoner_vstar": "parquet",
    "hr_bench_4k": "parquet",
    "hr_bench_8k": "parquet",
    "mme": "parquet_sharded",
    "mme_lite": "parquet_sharded",
    "visual_probe_train": "hf_dir",
    "deepeyes_train_4k": "hf_dir",
}
