"""A sink whose outputs are complete or absent, unit by unit.

Every value of a column is a *unit* (a configuration, a grid, a variant) with a
folder of JSON lines of its own. Tasks write to attempts that nobody reads; the
job's commit moves the parts of the attempts that won into the units' folders
and then puts a marker into each. Presence of the marker is completion: a task
that failed or was lost leaves no part behind, and a job that failed no marker.

A commit that is lost half way leaves folders without a marker; the next commit
of such a unit starts its folder anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MARKER, ATTEMPTS = "_DONE", "_attempts"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """Parts of one attempt: unit, file, rows."""

    parts: list[tuple[str, str, int]]


class UnitWriter(DataSourceArrowWriter):
    def __init__(self, path: str, unit: str, columns: list[str]):
        if unit not in columns:
            raise ValueError(f"no column {unit!r} to divide the rows by")
        self.path, self.unit, self.columns = path, unit, columns
        self.job = uuid.uuid4().hex  # drawn once, on the driver: all attempts of a job lie together

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _at(self.path)
        folder = f"{root}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder)
        counts: dict[str, int] = {}
        parts: list[tuple[str, str, int]] = []
        for n, batch in enumerate(iterator):
            units = batch.column(self.unit).cast(pa.string())
            if units.null_count:
                raise ValueError("a row belongs to no unit")
            # One file per unit and batch: no more than one is open.
            for u in pc.unique(units).to_pylist():
                some = batch.filter(pc.equal(units, u))
                name = f"{folder}/{n}-{quote(u, safe='')}"
                lines = "".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in some.to_pylist())
                with system.open_output_stream(name) as out:
                    out.write(lines.encode())
                counts[u] = counts.get(u, 0) + len(some)
                parts.append((u, name, len(some)))
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _at(self.path)
        units: dict[str, list[tuple[str, int]]] = {}
        for m in messages:
            for u, name, rows in m.parts if m else ():
                units.setdefault(u, []).append((name, rows))
        homes = {u: f"{root}/{quote(u, safe='')}" for u in units}
        done = [u for u, home in homes.items() if system.get_file_info(f"{home}/{MARKER}").type != fs.FileType.NotFound]
        if done:
            self._clear()
            raise FileExistsError(f"units that are complete already: {sorted(done)[:5]}")
        for u, parts in units.items():
            if system.get_file_info(homes[u]).type != fs.FileType.NotFound:
                system.delete_dir(homes[u])
            system.create_dir(homes[u])
            for i, (name, _) in enumerate(parts):
                system.move(name, f"{homes[u]}/part-{i:05d}.jsonl")
            marker = {"rows": sum(rows for _, rows in parts), "parts": len(parts)}
            with system.open_output_stream(f"{homes[u]}/{MARKER}.new") as out:
                out.write(json.dumps(marker).encode())
            system.move(f"{homes[u]}/{MARKER}.new", f"{homes[u]}/{MARKER}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Drop the job's attempts, those of tasks that failed among them."""
        system, root = _at(self.path)
        if system.get_file_info(f"{root}/{ATTEMPTS}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{ATTEMPTS}/{self.job}")


class UnitSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_units"

    def writer(self, schema: T.StructType, overwrite: bool) -> UnitWriter:
        if overwrite:
            raise ValueError("complete units are never overwritten: use mode append")
        return UnitWriter(self.options["path"], self.options["unit"], schema.fieldNames())


def write_units(rows: DataFrame, path: str, unit: str) -> None:
    """Write each unit's rows; units that have a marker already are refused, and nothing is written then."""
    rows.sparkSession.dataSource.register(UnitSink)
    rows.write.format("tessera_units").mode("append").option("unit", unit).save(path)


def done_units(spark: SparkSession, path: str) -> DataFrame:
    """(unit, rows, parts) of the complete units: their markers, listed once."""
    system, root = _at(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        marker = f"{info.path}/{MARKER}"
        if info.type == fs.FileType.Directory and info.base_name != ATTEMPTS and system.get_file_info(marker).type != fs.FileType.NotFound:
            with system.open_input_stream(marker) as f:
                said = json.loads(f.read())
            found.append((unquote(info.base_name), said["rows"], said["parts"]))
    return spark.createDataFrame(found, "unit string, rows long, parts long")


def read_units(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of the complete units."""
    homes = [f"{path.rstrip('/')}/{quote(r['unit'], safe='')}" for r in done_units(spark, path).collect()]
    if not homes:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(homes)


def write_missing(rows: DataFrame, path: str, unit: str) -> None:
    """Write the units that are not complete yet."""
    done = done_units(rows.sparkSession, path).select(F.col("unit").alias("_done"))
    write_units(rows.join(F.broadcast(done), F.col(unit).cast("string") == F.col("_done"), "left_anti"), path, unit)
