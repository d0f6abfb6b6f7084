"""Image files as tables: pixels and masks by Spark's image reader, positions and capture times from their headers."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import numbered
from .files import IMAGE_SUFFIXES, read_xmp

# Tag numbers of image headers.
GPS_DIRECTORY, EXIF_DIRECTORY, CAPTURED, FOCAL_35MM = 0x8825, 0x8769, 0x9003, 0xA405
GPS_LAT_REF, GPS_LAT, GPS_LON_REF, GPS_LON, GPS_ALT_REF, GPS_ALT = 1, 2, 3, 4, 5, 6
#: Bytes of one value by field type.
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """image, row, col and the channels r, g, b (equal for grey images) of every file of a folder."""
    files = spark.read.format("image").option("dropInvalid", True).load(folder).select(F.element_at(F.split("image.origin", "/"), -1).alias("image"), "image.height", "image.width", "image.nChannels", "image.data")

    def rows(batches):
        for b in batches:
            for name, h, w, n, data in b.itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(h * w, n)
                row, col = np.indices((h, w), np.int32).reshape(2, -1)
                channels = {c: a[:, at].astype(np.int32) for c, at in zip("rgb", (2, 1, 0) if n >= 3 else (0, 0, 0))}
                yield pd.DataFrame({"image": name, "row": row, "col": col, **channels})

    return files.mapInPandas(rows, "image string, row int, col int, r int, g int, b int")


def read_masks(spark: SparkSession, folder: str) -> DataFrame:
    """image (file name without suffix), row, col, dynamic: where a mask is brighter than half."""
    px = read_pixels(spark, folder)
    return px.select(F.regexp_replace("image", r"\.[^.]+$", "").alias("image"), "row", "col", (F.col("r") > 127).alias("dynamic"))


def directory(data: bytes, at: int, order: str) -> dict[int, tuple]:
    """The entries of one directory of a header: tag to values."""
    (n,), out = struct.unpack_from(order + "H", data, at), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = _SIZE.get(kind, 0) * count
        if not size:
            continue
        where = at + 2 + 12 * k + 8
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + size > len(data):
            continue
        if kind in (5, 10):
            v = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data, where)
            out[tag] = tuple(a / b if b else None for a, b in zip(v[::2], v[1::2]))
        elif kind in (2, 7):
            out[tag] = (data[where : where + size].split(b"\0")[0].decode("ascii", "replace"),)
        else:
            out[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind]}", data, where)
    return out


def header_of(data: bytes) -> dict:
    """lat, lon, abs_alt, captured and focal_35mm of an image's header; what it lacks is None."""
    start = data.find(b"Exif\0\0")
    base = data[start + 6 :] if start >= 0 else data if data[:4] in (b"II*\0", b"MM\0*") else b""
    found = dict.fromkeys(("lat", "lon", "abs_alt", "captured", "focal_35mm"))
    if len(base) < 8 or base[:2] not in (b"II", b"MM"):
        return found
    order = "<" if base[:2] == b"II" else ">"
    try:
        top = directory(base, struct.unpack_from(order + "I", base, 4)[0], order)
        gps = directory(base, top[GPS_DIRECTORY][0], order) if GPS_DIRECTORY in top else {}
        more = directory(base, top[EXIF_DIRECTORY][0], order) if EXIF_DIRECTORY in top else {}
    except struct.error:
        return found
    for name, ref, tag in (("lat", GPS_LAT_REF, GPS_LAT), ("lon", GPS_LON_REF, GPS_LON)):
        v = gps.get(tag)
        if v and len(v) == 3 and None not in v:
            found[name] = (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if str(gps.get(ref, ("N",))[0]).upper() in ("S", "W") else 1)
    if gps.get(GPS_ALT) and gps[GPS_ALT][0] is not None:
        found["abs_alt"] = gps[GPS_ALT][0] * (-1 if gps.get(GPS_ALT_REF, (0,))[0] == 1 else 1)
    found["captured"] = more.get(CAPTURED, (None,))[0]
    found["focal_35mm"] = float(more[FOCAL_35MM][0]) if FOCAL_35MM in more else None
    return found


def read_exif(spark: SparkSession, folder: str) -> DataFrame:
    """name, lat, lon, abs_alt, captured (timestamp without zone), focal_35mm of every image of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_SUFFIXES).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.substring("content", 1, 1 << 18).alias("head"))

    def rows(batches):
        for b in batches:
            yield pd.DataFrame([{"name": n, **header_of(bytes(d))} for n, d in zip(b["name"], b["head"])], columns=["name", "lat", "lon", "abs_alt", "captured", "focal_35mm"])

    got = files.mapInPandas(rows, "name string, lat double, lon double, abs_alt double, captured string, focal_35mm double")
    return got.withColumn("captured", F.try_to_timestamp("captured", F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"))


def photo_samples(spark: SparkSession, folder: str, fps: float = 1.0, least: int = 3) -> DataFrame:
    """A folder of positioned photos as a clip's telemetry: seq, name, t, dt and the fields of samples.

    Photos follow each other by capture time where all have one, else by name; fewer
    than ``least`` with a position is an error."""
    xmp = read_xmp(spark, folder)
    p = read_exif(spark, folder).join(xmp.select("name", "rel_alt", "gimbal_yaw", "gimbal_pitch", "gimbal_roll"), "name").where("lat IS NOT NULL AND lon IS NOT NULL")
    m = p.agg(F.count(F.lit(1)).alias("n"), F.count("captured").alias("timed")).first()
    if m["n"] < least:
        raise ValueError(f"only {m['n']} photos have a position")
    key = F.struct("captured", "name") if m["timed"] == m["n"] else F.struct("name")
    rows = numbered(p.withColumn("__order", key), "__order", "seq").drop("__order", "captured")
    return rows.withColumns({"t": (F.col("seq") - 1) / F.lit(float(fps)), "dt": F.lit(1.0 / fps)})
