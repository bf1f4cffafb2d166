"""Files from the first mirror that has them, into a folder addressed by content; what is there is not fetched again."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import _exists

INDEX = "_index"
#: Bytes that are read at a time.
CHUNK = 1 << 20

_FETCHED = "key string, name string, size long, mirror int, error string"
_ARROW = pa.schema([("key", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("mirror", pa.int32()), ("error", pa.string())])


def _at(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url)


def _copy(url: str, folder: str) -> tuple[str, int]:
    """Stream a file into the folder under the digest of its content; (name, size)."""
    source, path = _at(url)
    target, root = _at(folder)
    draft, digest, size = f"{root}/.{uuid.uuid4().hex}", hashlib.sha256(), 0
    try:
        with source.open_input_stream(path) as given, target.open_output_stream(draft) as taken:
            while chunk := given.read(CHUNK):
                taken.write(chunk)
                digest.update(chunk)
                size += len(chunk)
        # The same content from another row or attempt is the same file: whoever comes last replaces it by its equal.
        target.move(draft, f"{root}/{digest.hexdigest()}")
    except Exception:
        if target.get_file_info(draft).type != fs.FileType.NotFound:
            target.delete_file(draft)
        raise
    return digest.hexdigest(), size


def fetched(spark: SparkSession, folder: str) -> DataFrame:
    """(key, name, size, mirror) of what the folder holds."""
    path = f"{folder.rstrip('/')}/{INDEX}"
    done = spark.read.schema(_FETCHED).parquet(path) if _exists(spark, path) else spark.createDataFrame([], _FETCHED)
    return done.where("error is null").drop("error").dropDuplicates(["key"])


def fetch(rows: DataFrame, key: str, urls: str, folder: str) -> DataFrame:
    """Fetch the files of the rows that the folder does not have yet: (key, name, size, mirror, error) of these.

    ``urls`` is an array of places, tried in order; ``mirror`` is the place
    that answered, from 0. A row that none serves has the last error, and is
    tried again by the next call. Outcomes are appended to the folder's index
    before they are returned. A null key or no place at all is an error row.
    """
    spark, folder = rows.sparkSession, folder.rstrip("/")
    target, root = _at(folder)
    target.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, places in zip(batch.column("key").to_pylist(), batch.column("urls").to_pylist()):
                found, error = (None, None, None), "no place to fetch from"
                for i, place in enumerate(places or () if k is not None else ()):
                    try:
                        found, error = (*_copy(place, folder), i), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {place}"
                out.append((k, *found, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)

    wanted = rows.select(F.col(key).cast("string").alias("key"), F.col(urls).alias("urls")).dropDuplicates(["key"])
    missing = wanted.join(fetched(spark, folder).select("key"), "key", "left_anti")
    part = f"{folder}/{INDEX}/call={uuid.uuid4().hex[:12]}"
    missing.mapInArrow(run, _FETCHED).write.parquet(part)
    return spark.read.schema(_FETCHED).parquet(part)
