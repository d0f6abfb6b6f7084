"""Files of fixed-size binary records (LAS, binary PLY, depth arrays, rasters), read and written in byte ranges by many tasks.

Both ways are data sources of Spark's Python interface. Reading plans ranges from a
file's header, so a file of any size is read by as many tasks as it fills shares, and
only the columns asked for are decoded. Writing gives each task the bytes of its rows
at their places, which follow from row numbers; the driver writes the header alone.

Tasks open files by themselves: local and mounted ones directly, others by Arrow's file
systems (hdfs, s3, gs, ...). Listing, and putting a finished file in place, goes through
Spark's own."""

from __future__ import annotations

import json
import os
import struct
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range, and records decoded at a time.
SPLIT, BATCH = 32_000_000, 1 << 17
#: A header, in which a format's layout must be found.
HEAD = 1 << 22


class Layout(NamedTuple):
    """Where a file's records lie: bytes before the first, bytes of one, how many; ``fields`` maps a name to (NumPy type, offset in the record)."""

    first: int
    size: int
    count: int
    fields: dict
    more: dict


# By point format, bytes before the class, the time and the colours of a LAS record.
_LAS_CLASS = {**dict.fromkeys(range(6), 15), **dict.fromkeys(range(6, 11), 16)}
_LAS_TIME = {1: 20, 3: 20, 4: 20, 5: 20, **dict.fromkeys(range(6, 11), 22)}
_LAS_COLOUR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
# Scalar types of a PLY header.
_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def las_layout(head: bytes, length: int) -> Layout:
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    first, _, kind, size = struct.unpack_from("<IIBH", head, 96)
    (count,) = struct.unpack_from("<Q", head, 247) if head[25] >= 4 else struct.unpack_from("<I", head, 107)
    kind &= 0x3F
    fields = {"x": ("<i4", 0), "y": ("<i4", 4), "z": ("<i4", 8), "intensity": ("<u2", 12), "class": ("u1", _LAS_CLASS[kind])}
    if kind in _LAS_TIME:
        fields["gps_time"] = ("<f8", _LAS_TIME[kind])
    if kind in _LAS_COLOUR:
        fields |= {c: ("<u2", _LAS_COLOUR[kind] + 2 * i) for i, c in enumerate("rgb")}
    scale = struct.unpack_from("<6d", head, 131)
    return Layout(first, size, count, fields, {"scale": dict(zip("xyz", scale[:3])), "offset": dict(zip("xyz", scale[3:])), "bits": 0x1F if kind < 6 else 0xFF})


def ply_elements(head: bytes) -> tuple[str, int, list]:
    """(form, bytes of the header, elements as (name, count, properties)); a property is (name, type) or (name, (count type, type))."""
    end = head.index(b"end_header")
    at = head.index(b"\n", end) + 1
    form, elements = "", []
    for line in head[:end].decode("ascii", "replace").split("\n"):
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], (w[2], w[3]) if w[1] == "list" else w[1]))
    return form, at, elements


def ply_layout(head: bytes, length: int, element: str) -> Layout | None:
    """Where an element's records lie; None where they have no fixed size. Faces have one where all are triangles, which the file's length tells."""
    form, at, elements = ply_elements(head)
    if form == "ascii":
        return None
    order = "<" if form == "binary_little_endian" else ">"
    for k, (name, count, properties) in enumerate(elements):
        lists = [t for _, t in properties if isinstance(t, tuple)]
        fields, size = {}, 0
        for prop, t in properties:
            if isinstance(t, tuple):
                n, each = np.dtype(_PLY[t[0]]).itemsize, _PLY[t[1]]
                fields["corners"] = ("u1" if n == 1 else f"{order}{_PLY[t[0]]}", size)
                fields |= {f"v{i}": (order + each, size + n + i * np.dtype(each).itemsize) for i in range(3)}
                size += n + 3 * np.dtype(each).itemsize
            else:
                fields[prop] = (order + _PLY[t], size)
                size += np.dtype(_PLY[t]).itemsize
        if lists and (len(lists) > 1 or k + 1 < len(elements) or at + size * count != length):
            return None
        if name == element:
            return Layout(at, size, count, fields, {})
        at += size * count
    return Layout(at, 1, 0, {}, {})


def depth_layout(head: bytes, length: int, interleaved: bool) -> Layout:
    *numbers, _ = head.split(b"&", 3)
    w, h, c = map(int, numbers)
    return Layout(sum(map(len, numbers)) + 3, 4, w * h * c, {"depth": ("<f4", 0)}, {"shape": (h, w, c) if interleaved else (c, h, w), "axes": ("row", "col", "channel") if interleaved else ("channel", "row", "col")})


def raster_layout(head: bytes, length: int) -> Layout | None:
    """A GeoTIFF of 32-bit floats whose strips lie one behind the other; None for any other."""
    from .rasters import strips

    found = strips(head)
    if found is None:
        return None
    first, width, height, scale, tie, missing = found
    return Layout(first, 4, width * height, {"value": ("<f4", 0)}, {"width": width, "scale": scale, "tie": tie, "missing": missing})


def _las_columns(at: Layout, name: str, raw, index):
    if name in "xyz":
        return pa.array(raw[name] * at.more["scale"][name] + at.more["offset"][name])
    if name == "class":
        return pa.array((raw["class"] & at.more["bits"]).astype("i4"))
    return pa.array(raw[name].astype("f8" if name == "gps_time" else "i4"))


def _plain_columns(at: Layout, name: str, raw, index):
    return pa.array(raw[name].astype("i4" if name in "rgb" else "i8" if name in ("v0", "v1", "v2") else "f8"))


def _depth_columns(at: Layout, name: str, raw, index):
    if name == "depth":
        return pa.array(raw["depth"].astype("f4"))
    return pa.array(np.unravel_index(index, at.more["shape"])[at.more["axes"].index(name)].astype("i4"))


def _raster_columns(at: Layout, name: str, raw, index):
    row, col = np.divmod(index, at.more["width"])
    if name == "value":
        v = raw["value"]
        return pa.array(v.astype("f8"), mask=v == np.float32(at.more["missing"]))
    if name in ("row", "col"):
        return pa.array((row if name == "row" else col).astype("i4"))
    k, n = (0, col) if name == "x" else (1, -1 - row)
    return pa.array(at.more["tie"][3 + k] + (n + 0.5) * at.more["scale"][k])


#: Per format: all columns, the layout from a header, how a column is made.
FORMATS = {
    "las": ("source string, idx long, x double, y double, z double, r int, g int, b int, class int, intensity int, gps_time double", las_layout, _las_columns),
    "ply_points": ("source string, idx long, x double, y double, z double, r int, g int, b int", lambda h, n: _coloured(ply_layout(h, n, "vertex")), _plain_columns),
    "ply_faces": ("source string, fid long, v0 long, v1 long, v2 long", lambda h, n: ply_layout(h, n, "face"), _plain_columns),
    "depth": ("source string, row int, col int, channel int, depth float", lambda h, n: depth_layout(h, n, False), _depth_columns),
    "depth_interleaved": ("source string, row int, col int, channel int, depth float", lambda h, n: depth_layout(h, n, True), _depth_columns),
    "raster": ("source string, row int, col int, value double, x double, y double", raster_layout, _raster_columns),
}


def _coloured(at: Layout | None) -> Layout | None:
    """PLY names of colours to short ones."""
    return at and at._replace(fields={{"red": "r", "green": "g", "blue": "b"}.get(k, k): v for k, v in at.fields.items()})


def open_file(uri: str, mode: str = "rb"):
    """A file by its address, in a task."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), mode)
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    return fs.open_input_file(path) if mode == "rb" else fs.open_output_stream(path)


class Range(InputPartition):
    def __init__(self, path: str, layout: Layout, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.layout, self.first, self.count = path, layout, first, count


class RecordReader(DataSourceReader):
    def __init__(self, options, schema):
        self.kind, self.files, self.split = options["kind"], json.loads(options["files"]), int(options.get("split", SPLIT))
        self.columns = [(f.name, f.dataType) for f in schema.fields]

    def partitions(self):
        out = []
        for path, length in self.files:
            with open_file(path) as f:
                layout = FORMATS[self.kind][1](f.read(min(length, HEAD)), length)
            if layout is None:
                raise ValueError(f"{path}: its records have no fixed size")
            if layout.first + layout.size * layout.count > length:
                raise ValueError(f"{path}: {length} bytes are too few for {layout.count} records")
            each = max(1, self.split // layout.size)
            out += [Range(path, layout, at, min(each, layout.count - at)) for at in range(0, layout.count, each)]
        return out

    def read(self, part: Range):
        from pyspark.sql.pandas.types import to_arrow_type

        if part is None:  # no file has a record
            return
        at, make = part.layout, FORMATS[self.kind][2]
        kind = np.dtype({"names": list(at.fields), "formats": [t for t, _ in at.fields.values()], "offsets": [o for _, o in at.fields.values()], "itemsize": at.size})
        with open_file(part.path) as f:
            f.seek(at.first + part.first * at.size)
            for start in range(part.first, part.first + part.count, BATCH):
                n = min(BATCH, part.first + part.count - start)
                raw, index = np.frombuffer(f.read(n * at.size), kind), np.arange(start, start + n)
                if "corners" in at.fields and (raw["corners"] != 3).any():
                    raise ValueError(f"{part.path}: a face has other than three corners")
                columns = []
                for name, t in self.columns:
                    t = to_arrow_type(t)
                    if name == "source":
                        columns.append(pa.array([part.path] * n, t))
                    elif name in ("idx", "fid"):
                        columns.append(pa.array(index, t))
                    elif name in at.fields or name in at.more.get("axes", ()) or self.kind == "raster":
                        columns.append(make(at, name, raw, index).cast(t))
                    else:
                        columns.append(pa.nulls(n, t))
                yield pa.RecordBatch.from_arrays(columns, [name for name, _ in self.columns])


class Records(DataSource):
    """``spark.read.format("aero_records")`` with options kind and files; a schema chooses columns."""

    @classmethod
    def name(cls):
        return "aero_records"

    def schema(self):
        return FORMATS[self.options["kind"]][0]

    def reader(self, schema):
        return RecordReader(self.options, schema)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files that a path, a folder or a pattern names, by Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in fs.globStatus(at) or ()]
    found = [x for s in found for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    out = sorted((s.getPath().toString(), s.getLen()) for s in found if s.isFile() and s.getPath().getName()[0] not in "._")
    if not out:
        raise FileNotFoundError(path)
    return out


def header(uri: str, length: int) -> bytes:
    with open_file(uri) as f:
        return f.read(min(length, HEAD))


def read_records(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """The records of one file or many as rows; only ``columns``, if given, are decoded."""
    return _read(spark, listed(spark, path), kind, columns, split)


def _read(spark: SparkSession, files: list, kind: str, columns: list[str] | None, split: int) -> DataFrame:
    spark.dataSource.register(Records)
    types = dict(c.split(" ") for c in FORMATS[kind][0].split(", "))
    schema = ", ".join(f"{c} {types[c]}" for c in columns or types)
    return spark.read.format("aero_records").schema(schema).option("kind", kind).option("files", json.dumps(files)).option("split", split).load()


# writing


class Written(WriterCommitMessage):
    def __init__(self, size: int, parts: list):
        self.size, self.parts = size, parts


class BlockWriter(DataSourceArrowWriter):
    """Writes rows (pos, data) at their places in ``path``, beside which the file grows until it is whole.

    Where a file system can write in the middle of a file, tasks do so; where not, each
    leaves a part, and the commit strings parts together. A task that runs again writes
    the same bytes to the same places."""

    def __init__(self, options):
        self.path, self.size, self.head = options["path"], int(options["size"]), bytes.fromhex(options["head"])
        self.local = urlparse(self.path).scheme in ("", "file")
        if self.local:
            with open_file(f"{self.path}.tmp", "wb") as f:
                f.truncate(self.size)

    def write(self, batches):
        from pyspark import TaskContext

        size, parts = 0, []
        out = open_file(f"{self.path}.tmp", "r+b") if self.local else None
        try:
            for b in batches:
                for pos, data in zip(b.column("pos").to_pylist(), b.column("data")):
                    data = data.as_buffer()
                    size += data.size
                    if self.local:
                        out.seek(pos)
                        out.write(data)
                    else:
                        parts.append((pos, data.size, f"{self.path}.parts/{pos:020d}-{TaskContext.get().taskAttemptId()}"))
                        with open_file(parts[-1][2], "wb") as f:
                            f.write(data)
        finally:
            if out:
                out.close()
        return Written(size, parts)

    def commit(self, messages):
        written = len(self.head) + sum(m.size for m in messages if m)
        if written != self.size:
            self.abort(messages)
            raise ValueError(f"{self.path}: {written} bytes written, {self.size} expected")
        if self.local:
            with open_file(f"{self.path}.tmp", "r+b") as f:
                f.write(self.head)
            os.replace(unquote(urlparse(f"{self.path}.tmp").path), unquote(urlparse(self.path).path))
            return
        with open_file(self.path, "wb") as out:
            out.write(self.head)
            for _, _, part in sorted(p for m in messages if m for p in m.parts):
                with open_file(part) as f:
                    while block := f.read(1 << 23):
                        out.write(block)
        self._clear(messages)

    def abort(self, messages):
        if self.local:
            tmp = unquote(urlparse(f"{self.path}.tmp").path)
            if os.path.exists(tmp):
                os.remove(tmp)
        else:
            self._clear(messages)

    def _clear(self, messages):
        from pyarrow.fs import FileSystem

        for m in messages:
            for _, _, part in m.parts if m else ():
                fs, path = FileSystem.from_uri(part)
                fs.delete_file(path)


class Blocks(DataSource):
    """``df.write.format("aero_blocks")`` for rows (pos, data) of one file."""

    @classmethod
    def name(cls):
        return "aero_blocks"

    def schema(self):
        return "pos long, data binary"

    def writer(self, schema, overwrite):
        return BlockWriter(self.options)


def write_blocks(blocks: DataFrame, path: str, head: bytes, size: int) -> None:
    """One file of ``size`` bytes: a header and blocks (pos, data), each at its byte ``pos``. Tasks write; nothing is left behind if one fails."""
    spark = blocks.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    at = fs.makeQualified(at)
    fs.mkdirs(at.getParent())
    spark.dataSource.register(Blocks)
    blocks.select("pos", "data").write.format("aero_blocks").mode("append").option("path", at.toString()).option("size", size).option("head", head.hex()).save()


def pack_records(rows: DataFrame, number: str, fields: list[tuple[str, str]], first: int, constant: dict | None = None) -> DataFrame:
    """Numbered rows (from 0) as blocks (pos, data): neighbours in one batch become one block. Fields: (column, NumPy type) in the record's order; ``constant`` are fixed values of some."""
    constant = constant or {}
    kind = np.dtype([(c, t) for c, t in fields])
    names = [c for c, _ in fields if c not in constant]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = np.zeros(b.num_rows, kind)
            for c, _ in fields:
                out[c] = constant[c] if c in constant else b.column(c).to_numpy(zero_copy_only=False)
            i = b.column(number).to_numpy(zero_copy_only=False)
            order = np.argsort(i, kind="stable")
            i, out = i[order], out[order]
            cuts = np.flatnonzero(np.diff(i) != 1) + 1
            starts = [0, *cuts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(first + i[starts] * kind.itemsize), pa.array([x.tobytes() for x in np.split(out, cuts)], pa.binary())], ["pos", "data"])

    return rows.select(F.col(number).cast("long").alias(number), *[F.col(c) for c in names if c != number]).mapInArrow(run, "pos long, data binary")
