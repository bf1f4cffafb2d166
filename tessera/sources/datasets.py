"""Known datasets by name: where their files lie, how these are laid out, and what turns them into canonical rows.

``load`` puts the plan of a dataset together from Spark's own file sources, so
columns and filters that a user adds behind it reach the files; the files of a
sharded set are partitions, and a shard limit leaves the others unread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import convert
from tessera.sources import readers


@dataclass(frozen=True)
class Dataset:
    """``file`` may have ``i`` and ``n`` for shards; ``images`` is the folder that images are relative to."""

    layout: str
    file: str
    shards: int = 1
    images: str = "images"

    def __post_init__(self) -> None:
        if self.layout not in ("parquet", "parquet_sharded", "hf_dir"):
            raise ValueError(f"unknown layout {self.layout!r}")


# Shards and files of the known datasets.
KNOWN = {
    "hr_bench_4k": Dataset("parquet", "images.parquet"),
    "hr_bench_8k": Dataset("parquet", "images.parquet"),
    "mme_lite": Dataset("parquet_sharded", "images_{i}.parquet", 4),
    "mme": Dataset("parquet_sharded", "images_{i}.parquet", 70),
    "pixel_reasoner": Dataset("hf_dir", "release.parquet"),
    "pixel_reasoner_vstar": Dataset("hf_dir", "vstar.parquet"),
    "visual_probe_train": Dataset("hf_dir", "train.json", images="data"),
    "deepeyes_train_4k": Dataset("hf_dir", "train.json", images="data"),
}


def raw(spark: SparkSession, name: str, root: str, max_shards: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """The dataset's files under ``root`` as they are. Unknown names and missing files raise."""
    if name not in KNOWN:
        raise ValueError(f"unknown dataset {name!r}; choose from {sorted(KNOWN)}")
    known, root = KNOWN[name], root.rstrip("/")
    if known.layout == "parquet_sharded":
        if max_shards is not None and max_shards < 1:
            raise ValueError("at least one shard is needed")
        return readers.scan_sharded(spark, f"{root}/{known.file}", known.shards, max_shards)
    return readers.scan(spark, f"{root}/{known.file}", schema=schema)


def load(spark: SparkSession, name: str, root: str, max_shards: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """The dataset as canonical rows (problem, image, solution), images of a directory layout under its folder."""
    rows = convert.convert(raw(spark, name, root, max_shards, schema), name)
    if KNOWN[name].layout != "hf_dir":
        return rows
    folder, image = f"{root.rstrip('/')}/{KNOWN[name].images}", rows["image"]
    several = isinstance(rows.schema["image"].dataType, T.ArrayType)
    return rows.withColumn("image", convert.under(image, folder) if several else F.get(convert.under(F.array(image), folder), 0))
