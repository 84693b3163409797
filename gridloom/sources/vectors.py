"""Polylines and polygons in the public main-file, index and attribute format (.shp, .shx, .dbf), also zipped.

A partition of the reader is a run of records that the index names, so one large file is read by many tasks; of a zip
archive, whose members cannot be entered in the middle, each is one partition. Lengths that disagree, records that end early and
counts that do not fit are errors, never shorter results.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.commits import opened

#: Fixed values of the format: file code, version, bytes of the header, and the shape kinds that are read.
CODE, VERSION, HEAD = 9994, 1000, 100
NULL, POINT, LINE, POLYGON = 0, 1, 3, 5
RECORDS = 4096
SCHEMA = "source string, record long, kind int, parts array<int>, points array<struct<x:double,y:double>>, attributes map<string,string>"
ARROW = pa.schema(
    [
        ("source", pa.string()), ("record", pa.int64()), ("kind", pa.int32()), ("parts", pa.list_(pa.int32())),
        ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("attributes", pa.map_(pa.string(), pa.string())),
    ]
)


def content(kind: int, parts: list[int], points: list[tuple[float, float]]) -> bytes:
    """A record's content: kind, box, parts and points."""
    if kind == NULL:
        return struct.pack("<i", NULL)
    if kind == POINT:
        return struct.pack("<i2d", POINT, *points[0])
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    head = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(parts), len(points))
    return head + struct.pack(f"<{len(parts)}i", *parts) + b"".join(struct.pack("<2d", *p) for p in points)


def encoded(kind: int, shapes: list[tuple[list[int], list[tuple[float, float]]]]) -> tuple[bytes, bytes]:
    """(.shp, .shx) of shapes (parts, points)."""
    body, index, at = [], [], HEAD
    for i, (parts, points) in enumerate(shapes):
        c = content(kind if points else NULL, parts, points)
        body.append(struct.pack(">2i", i + 1, len(c) // 2) + c)
        index.append(struct.pack(">2i", at // 2, len(c) // 2))
        at += 8 + len(c)
    every = [p for _, points in shapes for p in points]
    box = (min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every)) if every else (0.0,) * 4
    head = lambda size: struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, kind, *box, 0.0, 0.0, 0.0, 0.0)
    return head(at) + b"".join(body), head(HEAD + 8 * len(index)) + b"".join(index)


def table(fields: list[tuple[str, int]], rows: list[list[str]]) -> bytes:
    """A .dbf of text fields (name, width)."""
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([w, 0]) + bytes(14) for n, w in fields)
    size = 1 + sum(w for _, w in fields)
    start = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 32 + len(head) + 1, size)
    return start + head + b"\r" + b"".join(b" " + b"".join(v.encode().ljust(w)[:w] for v, (_, w) in zip(r, fields, strict=True)) for r in rows) + b"\x1a"


def checked_header(head: bytes, size: int) -> int:
    """The file's kind; its stated length must be its size."""
    if len(head) < HEAD or struct.unpack(">i", head[:4])[0] != CODE:
        raise ValueError("not a main or index file")
    if struct.unpack(">i", head[24:28])[0] * 2 != size:
        raise ValueError("the file is shorter or longer than it says")
    return struct.unpack("<i", head[32:36])[0]


def parsed(data: bytes) -> tuple[int, list[int], list[tuple[float, float]]]:
    """(kind, parts, points) of a record's content."""
    (kind,) = struct.unpack_from("<i", data)
    if kind == NULL:
        return kind, [], []
    if kind == POINT:
        return kind, [0], [struct.unpack_from("<2d", data, 4)]
    if kind not in (LINE, POLYGON):
        raise ValueError(f"shape kind {kind} is not read")
    if len(data) < 44:
        raise ValueError("a record ends early")
    n_parts, n_points = struct.unpack_from("<2i", data, 36)
    if n_parts < 0 or n_points < 0 or len(data) != 44 + 4 * n_parts + 16 * n_points:
        raise ValueError("a record's counts do not fit its length")
    parts = list(struct.unpack_from(f"<{n_parts}i", data, 44))
    flat = struct.unpack_from(f"<{2 * n_points}d", data, 44 + 4 * n_parts)
    if parts != sorted(parts) or any(not 0 <= p < n_points for p in parts):
        raise ValueError("a part begins outside its record")
    return kind, parts, list(zip(flat[::2], flat[1::2], strict=True))


def records(f, first: int, places: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """(number, content) of consecutive records at (offset, length) in bytes."""
    for i, (offset, length) in enumerate(places):
        f.seek(offset)
        data = f.read(8 + length)
        if len(data) != 8 + length:
            raise ValueError("a record ends early")
        number, words = struct.unpack(">2i", data[:8])
        if number != first + i + 1 or 2 * words != length:
            raise ValueError("a record is not the one that the index names")
        yield number, data[8:]


class Attributes:
    """The rows of a .dbf by record number; without a file every row is empty."""

    def __init__(self, f, size: int):
        self.f, self.fields = f, []
        if f is None:
            return
        start = f.read(32)
        self.rows, self.start, self.size = struct.unpack("<IHH", start[4:12])
        if self.start + self.rows * self.size > size:
            raise ValueError("the attribute file ends early")
        head, at = f.read(self.start - 32), 1
        for i in range(0, len(head) - 31, 32):
            if head[i : i + 1] == b"\r":
                break
            self.fields.append((head[i : i + 11].split(b"\0")[0].decode(), at, head[i + 16]))
            at += head[i + 16]

    def of(self, number: int) -> dict[str, str]:
        if self.f is None:
            return {}
        if number > self.rows:
            raise ValueError("a shape without attributes")
        self.f.seek(self.start + (number - 1) * self.size)
        row = self.f.read(self.size)
        return {n: row[a : a + w].decode("utf-8", "replace").strip() for n, a, w in self.fields}


@dataclass
class Run(InputPartition):
    path: str
    stem: str
    first: int
    count: int


def _index(f, size: int) -> list[tuple[int, int]]:
    checked_header(f.read(HEAD), size)
    data = f.read(size - HEAD)
    return [(2 * o, 2 * n) for o, n in struct.iter_unpack(">2i", data)]


class ShapeReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path.rstrip("/"), size

    def _stems(self) -> list[tuple[str, str]]:
        """(file, stem) of every shape file; of a zip archive, of every member."""
        fs, base = opened(self.path)
        info = fs.get_file_info(base)
        found = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
        names = sorted(i.path for i in found if i.type == pyarrow.fs.FileType.File)
        out = []
        for name in names:
            if name.endswith(".zip"):
                with fs.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                    out += [(name, m[:-4]) for m in sorted(z.namelist()) if m.endswith(".shp")]
            elif name.endswith(".shp"):
                out.append((name, name[:-4]))
        return out

    def partitions(self) -> list[Run]:
        fs, _ = opened(self.path)
        out = []
        for path, stem in self._stems():
            if path.endswith(".zip"):
                out.append(Run(path, stem, 0, -1))
                continue
            size = fs.get_file_info(f"{stem}.shx").size
            n = (size - HEAD) // 8
            out += [Run(path, stem, i, min(self.size, n - i)) for i in range(0, n, self.size)]
        return out or [Run("", "", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.path)
        if partition.path.endswith(".zip"):
            with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
                names = set(z.namelist())
                blob = {e: z.read(f"{partition.stem}.{e}") for e in ("shp", "shx", "dbf") if f"{partition.stem}.{e}" in names}
            if "shx" not in blob:
                raise ValueError(f"{partition.stem} has no index")
            yield from self._batches(partition, *[io.BytesIO(blob[e]) if e in blob else None for e in ("shp", "shx", "dbf")], [len(blob.get(e, b"")) for e in ("shp", "shx", "dbf")])
            return
        sizes = [fs.get_file_info(f"{partition.stem}.{e}").size or 0 for e in ("shp", "shx", "dbf")]
        with fs.open_input_file(f"{partition.stem}.shp") as shp, fs.open_input_file(f"{partition.stem}.shx") as shx:
            if sizes[2]:
                with fs.open_input_file(f"{partition.stem}.dbf") as dbf:
                    yield from self._batches(partition, shp, shx, dbf, sizes)
            else:
                yield from self._batches(partition, shp, shx, None, sizes)

    def _batches(self, run: Run, shp, shx, dbf, sizes: list[int]) -> Iterator[pa.RecordBatch]:
        checked_header(shp.read(HEAD), sizes[0])
        places = _index(shx, sizes[1])
        places = places[run.first :] if run.count < 0 else places[run.first : run.first + run.count]
        attributes, rows = Attributes(dbf, sizes[2]), []
        for number, data in records(shp, run.first, places):
            kind, parts, points = parsed(data)
            rows.append({"source": run.stem.rsplit("/", 1)[-1], "record": number, "kind": kind, "parts": parts, "points": [{"x": x, "y": y} for x, y in points], "attributes": list(attributes.of(number).items())})
            if len(rows) == 1024:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class Shapes(DataSource):
    """Format `gridloom-shapes`; options: path (a file or a folder), records (read by one task)."""

    @classmethod
    def name(cls) -> str:
        return "gridloom-shapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(self.options["path"], int(self.options.get("records", RECORDS)))


def read_shapes(spark: SparkSession, path: str, *, records_a_task: int = RECORDS) -> DataFrame:
    spark.dataSource.register(Shapes)
    return spark.read.format(Shapes.name()).options(path=path, records=str(records_a_task)).load()


def write_shapes(lines: DataFrame, folder: str, kind: int = LINE) -> DataFrame:
    """(file, shapes): one zipped trio of files a row group of lines (file, name, points): points as array of struct(x, y) in order.

    A file's lines are one task's group, so `file` must not hold more than a task can; a repeated task writes the same names.
    """

    def run(key: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        rows = sorted(data.to_pylist(), key=lambda r: r["name"])
        shp, shx = encoded(kind, [([0], [(p["x"], p["y"]) for p in r["points"]]) for r in rows])
        dbf = table([("name", 32)], [[r["name"]] for r in rows])
        name, blob = key[0].as_py(), io.BytesIO()
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
            for e, b in (("shp", shp), ("shx", shx), ("dbf", dbf)):
                z.writestr(f"{name}.{e}", b)
        with fs.open_output_stream(f"{base}/{name}.zip", compression=None) as f:
            f.write(blob.getvalue())
        return pa.table({"file": pa.array([f"{name}.zip"]), "shapes": pa.array([len(rows)], pa.int64())})

    return lines.select("file", "name", "points").groupBy("file").applyInArrow(run, "file string, shapes long")
