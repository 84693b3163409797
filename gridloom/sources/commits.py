"""A sink in two phases: tasks stage checked parts, the driver commits them by one manifest or not at all.

Each task writes its rows to a part of its own name below `<path>/parts` and counts, sums and checks them. The commit compares
the counts with what was promised and then moves a manifest to `<path>/CURRENT`; readers take the parts that CURRENT
names, so until that move, and after any failure before it, they see the old table whole. Parts of failed or repeated tasks
are never named. A task that meets a bad row fails, and the write with it.

Files go through pyarrow's file systems: a mount, HDFS or an object store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    part: str
    rows: int
    keys: int


class StagedWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.schema, self.options = options["path"].rstrip("/"), schema, dict(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, base = opened(self.path)
        fs.create_dir(f"{base}/parts", recursive=True)
        part, rows, keys, out = f"part-{uuid.uuid4().hex}.parquet", 0, 0, None
        key, value = self.options.get("key"), self.options.get("value")
        low, high = (float(self.options[k]) if k in self.options else None for k in ("low", "high"))
        try:
            for batch in iterator:
                if key:
                    ids = batch.column(key)
                    if ids.null_count:
                        raise ValueError(f"a null {key}")
                    keys += sum(ids.to_pylist())
                if value:
                    v = batch.column(value).cast(pa.float64())
                    known = v.drop_null()
                    if len(known) and not pc.all(pc.is_finite(known)).as_py():
                        raise ValueError(f"{value} is not finite")
                    if len(known) and ((low is not None and pc.min(known).as_py() < low) or (high is not None and pc.max(known).as_py() > high)):
                        raise ValueError(f"{value} outside [{low}, {high}]")
                    if v.null_count and self.options.get("nulls") == "refuse":
                        raise ValueError(f"a null {value}")
                if out is None:
                    out = pq.ParquetWriter(f"{base}/parts/{part}", batch.schema, filesystem=fs)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Staged(part if rows else "", rows, keys)

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m for m in messages if m is not None]
        rows, keys = sum(m.rows for m in done), sum(m.keys for m in done)
        want = self.options.get("rows")
        if want is not None and rows != int(want):
            raise ValueError(f"{rows} rows staged, {want} promised")
        want = self.options.get("keys")
        if want is not None and keys != int(want):
            raise ValueError("the staged keys are not those promised")
        manifest = {"parts": sorted(m.part for m in done if m.part), "rows": rows, "schema": self.schema.json()}
        fs, base = opened(self.path)
        name = f"{base}/manifest-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(name) as f:
            f.write(json.dumps(manifest).encode())
        fs.move(name, f"{base}/CURRENT")  # the one step that readers can see

    def abort(self, messages: list[Staged | None]) -> None:
        fs, base = opened(self.path)
        for m in messages:
            if m is not None and m.part:
                fs.delete_file(f"{base}/parts/{m.part}")


class StagedTable(DataSource):
    """Format `gridloom-staged`; options: path; key and value columns; low, high; nulls=refuse; rows and keys (their sum) promised."""

    @classmethod
    def name(cls) -> str:
        return "gridloom-staged"

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        return StagedWriter(schema, self.options)


def write_staged(df: DataFrame, path: str, **options: object) -> None:
    """Replace the table at path by df, whole or not at all."""
    spark = df.sparkSession
    spark.dataSource.register(StagedTable)
    df.write.format(StagedTable.name()).mode("append").options(path=path, **{k: str(v) for k, v in options.items()}).save()


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """The table that was last committed at path."""
    fs, base = opened(path.rstrip("/"))
    with fs.open_input_stream(f"{base}/CURRENT") as f:
        manifest = json.loads(f.read())
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/parts/{p}" for p in manifest["parts"]])

