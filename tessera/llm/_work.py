"""Shared working storage and small DataFrame helpers for the operators of this subpackage.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor can read, so a lost executor never takes the only copy along.
Where that setting is absent, a local session (unit tests, notebooks) gets a
folder made and set; any other session is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of keys up to which it is broadcast; above that the join shuffles.
BROADCAST_ROWS = 250_000

_made: list[tuple[SparkSession, str]] = []


def work_root(spark: SparkSession) -> str:
    """The shared folder: the session's ``spark.checkpoint.dir``, else one made for local runs."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-work-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*stored: DataFrame) -> None:
    """Delete stored tables whose last reader has finished."""
    for df in stored:
        drop_path(df.sparkSession, df.stored_at)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_few(keys: DataFrame, most: int | None = None) -> bool:
    """Whether a stored table of narrow rows may be broadcast: it has at most ``most`` of them."""
    most = BROADCAST_ROWS if most is None else most
    return keys.limit(most + 1).count() <= most


def bounded(keys: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if they are few, else to be merged."""
    return F.broadcast(keys) if is_few(keys, most) else keys.hint("merge")


def with_ids(rows: DataFrame, ids: DataFrame, how: str, most: int | None = None, on: str = "doc_id") -> DataFrame:
    """Semi or anti join of documents with a stored table of distinct ids."""
    name = free_name(rows, "wanted_id")
    return rows.join(bounded(ids.toDF(name), most), F.col(on) == F.col(name), how)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
