"""Rasters as GeoTIFF files: 32-bit floats, a row a strip, position and missing value in the header."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import read_records, write_blocks

NODATA = -9999.0
# Tag numbers and field types of the container.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, MISSING = 33550, 33922, 34735, 42113
_TYPES = {"H": (3, 2), "I": (4, 4), "d": (12, 8), "s": (2, 1)}


def header(width: int, height: int, xmin: float, ymax: float, gsd: float, epsg: int | None, nodata: float) -> bytes:
    """All bytes before the first strip."""
    text = f"{nodata:g}\0".encode()
    keys = [1, 1, 0, 2 + (epsg is not None), 1024, 0, 1, 1 if epsg else 32767, 1025, 0, 1, 1] + ([3072, 0, 1, epsg] if epsg else [])
    strip = 4 * width
    tags = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [32]), (COMPRESSION, "H", [1]), (PHOTOMETRIC, "H", [1]), (OFFSETS, "I", [0] * height), (SAMPLES, "H", [1]), (ROWS, "I", [1]), (COUNTS, "I", [strip] * height),
        (FORMAT, "H", [3]), (PIXEL_SCALE, "d", [gsd, gsd, 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, xmin, ymax, 0.0]), (GEO_KEYS, "H", keys), (MISSING, "s", [text]),
    ]
    size = lambda kind, v: len(v[0]) if kind == "s" else _TYPES[kind][1] * len(v)
    at = 8 + 2 + 12 * len(tags) + 4
    first = at + sum(n + n % 2 for _, kind, v in tags if (n := size(kind, v)) > 4)
    if first + strip * height >= 1 << 32:
        raise ValueError("a raster of 4 GB or more: write it in parts")
    entries, extra = b"", b""
    for tag, kind, v in tags:
        v = [first + strip * i for i in range(height)] if tag == OFFSETS else v
        raw = v[0] if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
        entries += struct.pack("<HHI", tag, _TYPES[kind][0], len(raw) if kind == "s" else len(v))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + entries + struct.pack("<I", 0) + extra


def write_geotiff(cells: DataFrame, path: str, width: int, height: int, xmin: float, ymax: float, gsd: float, epsg: int | None = None, nodata: float = NODATA) -> None:
    """Cells (row, col, value) as one file; cells that are null or not listed are missing. Rows are packed in tasks."""
    rows = cells.sparkSession.range(height).select(F.col("id").alias("row"))
    listed = cells.where("value IS NOT NULL").groupBy(F.col("row").cast("long").alias("row")).agg(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("value").cast("float").alias("value"))).alias("cells"))

    head = header(width, height, xmin, ymax, gsd, epsg, nodata)

    def pack(batches):
        for b in batches:
            out = []
            for found in b["cells"]:
                line = np.full(width, nodata, "<f4")
                for c in found if found is not None else ():
                    line[c["col"]] = c["value"]
                out.append(line.tobytes())
            yield pd.DataFrame({"pos": len(head) + 4 * width * b["row"], "data": out})

    blocks = rows.join(listed, "row", "left").mapInPandas(pack, "pos long, data binary")
    write_blocks(blocks, path, head, len(head) + 4 * width * height)


def strips(head: bytes) -> tuple | None:
    """(first byte, width, height, scale, tie point, missing value) from the start of a file whose rows lie one behind the other as ``write_geotiff`` makes them; None for others."""
    from .images import directory

    tags = directory(head, struct.unpack_from("<I", head, 4)[0], "<")
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    at, n = np.array(tags[OFFSETS]), np.array(tags[COUNTS])
    if head[:2] != b"II" or tags[BITS][0] != 32 or tags[COMPRESSION][0] != 1 or n.sum() != 4 * w * h or (np.diff(at) != n[:-1]).any():
        return None
    missing = float(tags[MISSING][0]) if MISSING in tags else float("nan")
    return int(at[0]), w, h, _doubles(head, PIXEL_SCALE, 3), _doubles(head, TIE_POINT, 6), missing


def read_geotiff(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """source, row, col, value (null where missing), x, y (cell centres) of files as ``write_geotiff`` makes them, read in ranges of rows."""
    return read_records(spark, path, "raster", columns)


def _doubles(data: bytes, tag: int, n: int) -> tuple:
    (at,) = struct.unpack_from("<I", data, 4)
    (count,) = struct.unpack_from("<H", data, at)
    for k in range(count):
        t, _, _, where = struct.unpack_from("<HHII", data, at + 2 + 12 * k)
        if t == tag:
            return struct.unpack_from(f"<{n}d", data, where)
    return (0.0,) * n
