"""Sparse reconstructions: text and binary camera, image and point files.

The text form is read with Spark's line reader and expressions, files of records of
one size in byte ranges (``records``), the other binary forms file by file."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.camera import quaternion_matrix
from ..functions.geodesy import camera_centre
from . import records

# Camera model numbers, names and parameter counts of the binary format.
MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no comments, in file order: n, f (fields split at spaces)."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where("NOT startswith(line, '#')")
    return lines.withColumn("f", F.split(F.trim("line"), r"\s+"))


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where("line <> ''")
    return rows.selectExpr("cast(f[0] AS int) AS camera_id", "f[1] AS model", "cast(f[2] AS int) AS width", "cast(f[3] AS int) AS height", "transform(slice(f, 5, size(f)), x -> cast(x AS double)) AS params")


def _image_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Every image has two lines: its pose and its keypoints (which may be empty)."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.filter(F.split("value", "\r?\n"), lambda x: ~F.startswith(x, F.lit("#"))).alias("lines"))
    pair = lines.select("lines", F.explode(F.sequence(F.lit(0), F.size("lines"), F.lit(2))).alias("k"))
    fields = lambda i: F.split(F.trim(F.coalesce(F.get("lines", F.col("k") + i), F.lit(""))), r"\s+")
    return pair.select(fields(0).alias("f"), fields(1).alias("kp")).where("size(f) >= 10")


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """image_id, name, camera_id, r_cw (9), t_cw (3), centre (3)."""
    num = lambda i: F.col("f")[i].cast("double")
    rows = _image_pairs(spark, path).select(
        F.col("f")[0].cast("int").alias("image_id"), F.array_join(F.slice("f", 10, F.size("f")), " ").alias("name"), F.col("f")[8].cast("int").alias("camera_id"),
        quaternion_matrix(num(1), num(2), num(3), num(4)).alias("r_cw"), F.array(num(5), num(6), num(7)).alias("t_cw"),
    )
    return rows.withColumn("centre", F.array(*camera_centre(F.col("r_cw"), F.col("t_cw"))))


def read_observations_text(spark: SparkSession, path: str) -> DataFrame:
    """image_id, kp_idx, u, v, point_id (null where not triangulated)."""
    rows = _image_pairs(spark, path).selectExpr("cast(f[0] AS int) AS image_id", "posexplode(transform(sequence(0, cast(size(kp) / 3 AS int) - 1), i -> slice(kp, 3 * i + 1, 3))) AS (kp_idx, p)")
    rows = rows.where("size(p) = 3")
    return rows.selectExpr("image_id", "kp_idx", "cast(p[0] AS float) AS u", "cast(p[1] AS float) AS v", "CASE WHEN cast(p[2] AS bigint) >= 0 THEN cast(p[2] AS bigint) END AS point_id")


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where("line <> ''")
    return rows.selectExpr(
        "cast(f[0] AS bigint) AS point_id", "cast(f[1] AS double) AS x", "cast(f[2] AS double) AS y", "cast(f[3] AS double) AS z", "cast(f[4] AS int) AS r", "cast(f[5] AS int) AS g", "cast(f[6] AS int) AS b",
        "cast(f[7] AS double) AS error", "cast((size(f) - 8) / 2 AS int) AS track_len",
    )


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The text model of a folder: cameras, images, observations, points3d."""
    return {
        "cameras": read_cameras_text(spark, f"{folder}/cameras.txt"), "images": read_images_text(spark, f"{folder}/images.txt"),
        "observations": read_observations_text(spark, f"{folder}/images.txt"), "points3d": read_points_text(spark, f"{folder}/points3D.txt"),
    }


def _unpacked(fmt: str, data: bytes, at: int) -> tuple[tuple, int]:
    return struct.unpack_from("<" + fmt, data, at), at + struct.calcsize("<" + fmt)


def cameras_of(data: bytes):
    (n,), at = _unpacked("Q", data, 0)
    for _ in range(n):
        (cam, model, w, h), at = _unpacked("iiQQ", data, at)
        name, count = MODELS[model]
        params, at = _unpacked(f"{count}d", data, at)
        yield cam, name, int(w), int(h), list(params)


def images_of(data: bytes):
    (n,), at = _unpacked("Q", data, 0)
    for _ in range(n):
        head, at = _unpacked("i7di", data, at)
        end = data.index(b"\0", at)
        name, at = data[at:end].decode("utf-8", "replace"), end + 1
        (k,), at = _unpacked("Q", data, at)
        at += 24 * k
        yield head[0], name, head[8], list(head[1:5]), list(head[5:8]), int(k)


def points_of(data: bytes):
    (n,), at = _unpacked("Q", data, 0)
    for _ in range(n):
        v, at = _unpacked("Qddd3BdQ", data, at)
        at += 8 * v[8]
        yield v[0], v[1], v[2], v[3], v[4], v[5], v[6], v[7], int(v[8])


_BINARY = {
    "cameras": (cameras_of, "camera_id int, model string, width int, height int, params array<double>"),
    "images": (images_of, "image_id int, name string, camera_id int, quaternion array<double>, t_cw array<double>, n_keypoints int"),
    "points": (points_of, "point_id long, x double, y double, z double, r int, g int, b int, error double, track_len int"),
}


def read_binary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Binary cameras, images or points. Files come through Spark's own reader, so any store works."""
    read, schema = _BINARY[kind]

    def rows(batches):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(list(read(bytes(content))), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def best_model(counts: DataFrame) -> DataFrame:
    """The sub-model with most registered images; the smaller name on ties. Columns: model, n_images."""
    return counts.orderBy(F.desc(F.coalesce("n_images", F.lit(0))), "model").limit(1)


def track_table(observations: DataFrame, points: DataFrame) -> DataFrame:
    """Flat observations of triangulated points."""
    return observations.join(points.select("point_id"), "point_id").select("image_id", "point_id", "u", "v")


def pose_table(images: DataFrame, observations: DataFrame) -> DataFrame:
    """Images by name with their number of triangulated keypoints."""
    seen = observations.groupBy("image_id").agg(F.count_if(F.col("point_id").isNotNull()).alias("n_points"))
    return images.join(seen, "image_id", "left").select("name", "image_id", "camera_id", "r_cw", "t_cw", F.coalesce("n_points", F.lit(0)).alias("n_points")).orderBy("name")


# Sizes of the container's scalar types.
_PLY = {"char": "b", "uchar": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "double": "d", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "float32": "f", "float64": "d"}


def ply_header(data: bytes) -> tuple[str, list, int]:
    """(format, [(element, count, [(property, type or (count type, item type))])], where the data start)."""
    end = data.index(b"end_header")
    at = data.index(b"\n", end) + 1
    form, elements = "ascii", []
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[4], (w[2], w[3])) if w[1] == "list" else (w[2], w[1]))
    return form, elements, at


def ply_rows(data: bytes, element: str):
    """Rows of one element as dicts, for ASCII and both byte orders."""
    form, elements, at = ply_header(data)
    words = iter(data[at:].split()) if form == "ascii" else None
    order = ">" if "big" in form else "<"
    for name, count, props in elements:
        for _ in range(count):
            row = {}
            for prop, kind in props:
                if isinstance(kind, tuple):
                    if words:
                        row[prop] = [int(next(words)) for _ in range(int(next(words)))]
                    else:
                        (k,) = struct.unpack_from(order + _PLY[kind[0]], data, at)
                        at += struct.calcsize(_PLY[kind[0]])
                        row[prop] = list(struct.unpack_from(f"{order}{k}{_PLY[kind[1]]}", data, at))
                        at += k * struct.calcsize(_PLY[kind[1]])
                elif words:
                    row[prop] = float(next(words))
                else:
                    (row[prop],) = struct.unpack_from(order + _PLY[kind], data, at)
                    at += struct.calcsize(_PLY[kind])
            if name == element:
                yield row


def read_ply_points(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """source, idx, x, y, z, r, g, b (colours null where the file has none). Binary files are read in ranges, a text file by one task."""

    def rows(data):
        out = [(i, p["x"], p["y"], p["z"], *(int(p[c]) if c in p else None for c in ("red", "green", "blue"))) for i, p in enumerate(ply_rows(data, "vertex"))]
        return out, ["idx", "x", "y", "z", "r", "g", "b"], {"r": "Int32", "g": "Int32", "b": "Int32"}

    return _read_ply(spark, path, "ply_points", columns, rows)


def read_ply_faces(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """source, fid, v0, v1, v2; faces of more corners become fans. Binary files of triangles are read in ranges, others by one task each."""

    def rows(data):
        out = []
        for f in ply_rows(data, "face"):
            ids = next(iter(f.values()))
            out += [(len(out) + k - 1, ids[0], ids[k], ids[k + 1]) for k in range(1, len(ids) - 1)]
        return out, ["fid", "v0", "v1", "v2"], {}

    return _read_ply(spark, path, "ply_faces", columns, rows)


def _read_ply(spark: SparkSession, path: str, kind: str, columns: list[str] | None, rows) -> DataFrame:
    """Files of fixed-size records by ranges, together with the others, whose whole text a task turns into ``rows``."""
    ranged, whole = [], []
    for file, length in records.listed(spark, path):
        (ranged if records.FORMATS[kind][1](records.header(file, length), length) else whole).append((file, length))
    out = records._read(spark, ranged, kind, columns, records.SPLIT) if ranged else None
    if whole:

        def read(batches):
            import pandas as pd

            for b in batches:
                for source, content in zip(b["path"], b["content"]):
                    found, names, types = rows(bytes(content))
                    got = pd.DataFrame(found, columns=names).astype(types)
                    got.insert(0, "source", source)
                    yield got

        texts = spark.read.format("binaryFile").load([f for f, _ in whole]).select("path", "content").mapInPandas(read, records.FORMATS[kind][0])
        texts = texts.select(*columns) if columns else texts
        out = texts if out is None else out.unionByName(texts)
    return out


def read_las(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """source, idx, x, y, z (metres), r, g, b (16 bits, null where the format has none), class, intensity, gps_time of LAS files, read in ranges of records."""
    return records.read_records(spark, path, "las", columns)


def read_depth_arrays(spark: SparkSession, path: str, interleaved: bool = False, columns: list[str] | None = None) -> DataFrame:
    """source, row, col, channel, depth of arrays with an ASCII ``w&h&c&`` header, then float32; older files have the channels last (``interleaved``). Read in ranges."""
    return records.read_records(spark, path, "depth_interleaved" if interleaved else "depth", columns)
