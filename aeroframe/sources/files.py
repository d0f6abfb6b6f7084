"""Other inputs and all outputs: image listings, JSON contracts, metadata, runs; CSV, JSON, GeoJSON, PLY, OBJ, LAS, GLB."""

from __future__ import annotations

import json
import os
import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geodesy import apply_sim3
from ..functions.vectors import col
from ..operators.joins import numbered, numbered_as_is
from ..session import materialise
from .records import pack_records, write_blocks

IMAGE_SUFFIXES = "*.{jpg,jpeg,png,tif,tiff,bmp,JPG,JPEG,PNG,TIF,TIFF,BMP}"


# inputs
def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, length of every image file of a folder, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_SUFFIXES).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length").orderBy("name")


def folder_frames(images: DataFrame, hz: float) -> DataFrame:
    """An image folder as a clip: frame_index by name, t = frame_index / hz."""
    from ..operators.joins import numbered

    images = numbered(images, "name", "frame_index")
    return images.withColumn("frame_index", (F.col("frame_index") - 1).cast("long")).withColumn("t", F.col("frame_index") / F.lit(float(hz)))


def thin_frames(frames: DataFrame, fps: float, hz: float) -> DataFrame:
    """Every round(fps / hz)-th frame of a video."""
    return frames.where(F.col("frame_index") % max(1, round(fps / hz)) == 0)


def wanted_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    return frames.join(wanted.select("frame_index"), "frame_index", "left_semi")


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def typed_number(c) -> "F.Column":
    """Text of a table cell as a number; empty and None are null."""
    return F.when(~F.trim(col(c)).isin("", "None", "null", "NaN"), F.trim(col(c))).try_cast("double")


def read_depth_contract(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of a depth folder's JSON header, one row each."""
    return spark.read.json(path, multiLine=True).select(F.explode("cameras").alias("c")).select("c.*")


def with_confidence(pixels: DataFrame) -> DataFrame:
    """Missing confidence is 1 where the depth is valid, else 0."""
    return pixels.withColumn("conf", F.coalesce(F.col("conf").cast("float"), (F.col("z") > 0).cast("int").cast("float")))


def with_mask(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Adds ``dynamic``; a pixel without a mask is static."""
    return pixels.join(masks.select("image", "row", "col", "dynamic"), ["image", "row", "col"], "left").withColumn("dynamic", F.coalesce("dynamic", F.lit(False)))


def read_sim3(spark: SparkSession, path: str) -> tuple[float, list[float], list[float]]:
    """(scale, rotation of 9, translation) of a one-record JSON file."""
    r = spark.read.json(path, multiLine=True).select("scale", F.flatten("rotation").alias("rotation"), "translation").first()
    return r["scale"], list(r["rotation"]), list(r["translation"])


def read_xmp(spark: SparkSession, folder: str) -> DataFrame:
    """name and the numbers that image headers carry as drone attributes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_SUFFIXES).load(folder)
    # The metadata packet wherever it lies; the whole file where no packet is marked.
    head = F.substring_index(F.substring_index(F.decode("content", "ISO-8859-1"), "</x:xmpmeta>", 1), "<x:xmpmeta", -1)
    # Attribute names of the metadata packet.
    names = {"abs_alt": "AbsoluteAltitude", "rel_alt": "RelativeAltitude", "gimbal_yaw": "GimbalYawDegree", "gimbal_pitch": "GimbalPitchDegree", "gimbal_roll": "GimbalRollDegree", "lat": "GpsLatitude", "lon": "GpsLongitude"}
    got = [F.regexp_extract("__packet", rf'{n}\s*=\s*"\s*([-+]?\d+(?:\.\d+)?)', 1).try_cast("double").alias(k) for k, n in names.items()]
    # A generator of one row keeps the packet from being looked for once a number.
    files = files.select("path", F.explode(F.array(head)).alias("__packet"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), *got)


def dms_degrees(degrees, minutes, seconds, ref) -> "F.Column":
    """Degrees, minutes and seconds with a hemisphere letter."""
    v = col(degrees) + col(minutes) / 60 + col(seconds) / 3600
    return F.when(F.upper(col(ref)).isin("S", "W"), -v).otherwise(v)


def collect_run(spark: SparkSession, folder: str, parts=("report", "gates", "eval", "georef", "meta")) -> DataFrame:
    """One JSON document of a run's records; records that are missing are null. run_id is the join key."""
    out = spark.createDataFrame([(os.path.basename(folder.rstrip("/")),)], "run_id string")
    for name in parts:
        try:
            part = spark.read.text(f"{folder}/{name}.json", wholetext=True)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            part = None
        out = out.crossJoin(part.select(F.col("value").alias(name))) if part is not None else out.withColumn(name, F.lit(None).cast("string"))
    return out.withColumn("document", F.to_json(F.struct("run_id", *parts)))


def srt_text(samples: DataFrame) -> DataFrame:
    """Subtitle blocks of telemetry samples, for fixtures: seq, block."""
    clock = lambda t: F.format_string("%02d:%02d:%02d,%03d", *[F.floor(x).cast("int") for x in (t / 3600, t % 3600 / 60, t % 60, (t * 1000 + 0.5) % 1000)])
    t = F.col("t")
    body = F.format_string("[latitude: %.7f] [longitude: %.7f] [rel_alt: %.3f abs_alt: %.3f] [gb_yaw: %.1f gb_pitch: %.1f gb_roll: %.1f]", *[F.col(c).cast("double") for c in ("lat", "lon", "rel_alt", "abs_alt", "gimbal_yaw", "gimbal_pitch", "gimbal_roll")])
    return samples.select("seq", F.concat(F.col("seq").cast("string"), F.lit("\n"), clock(t), F.lit(" --> "), clock(t + F.col("dt")), F.lit("\n"), body).alias("block"))


def flight(spark: SparkSession, n: int, hz: float = 10.0, lat0: float = 47.0, lon0: float = 8.0, speed: float = 8.0, altitude: float = 60.0, heading: float = 90.0) -> DataFrame:
    """Samples of a straight flight, for fixtures."""
    m = 111_320.0
    d = F.col("id") / hz * speed
    rad = F.radians(F.lit(heading))
    return spark.range(n).select(
        F.col("id").alias("seq"), (F.col("id") / hz).alias("t"), F.lit(1 / hz).alias("dt"), (F.lit(lat0) + d * F.cos(rad) / m).alias("lat"), (F.lit(lon0) + d * F.sin(rad) / (m * F.cos(F.radians(F.lit(lat0))))).alias("lon"),
        F.lit(altitude).alias("rel_alt"), F.lit(altitude + 400).alias("abs_alt"), F.lit(heading).alias("gimbal_yaw"), F.lit(-60.0).alias("gimbal_pitch"), F.lit(0.0).alias("gimbal_roll"),
    )


# outputs
def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; Spark's committer makes the folder appear whole."""
    df.write.mode("overwrite").json(path)


def write_record(record: dict, path: str) -> None:
    """One small document on the driver, put in place by rename."""
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(record, f, indent=2, default=float)
    os.replace(tmp, path)


def write_csv(df: DataFrame, path: str) -> None:
    """A header and rows; an empty table is refused."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.mode("overwrite").csv(path, header=True)


def geojson_features(buildings: DataFrame, ring="ring_lonlat", properties: list[str] | None = None) -> DataFrame:
    """One GeoJSON feature per building, in order of id: id, feature. Rings are closed."""
    properties = properties or [c for c in buildings.columns if c != ring]
    pts = F.transform(F.concat(F.col(ring), F.slice(ring, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(pts).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return buildings.select("id", F.to_json(feature).alias("feature")).orderBy("id")


def write_text_file(lines: DataFrame, path: str, sep: str = "\n") -> None:
    """One text file of rows (pos, line) in order of pos, ``sep`` after each, in any store that Spark writes to.

    Tasks format and write the parts; the driver only copies their bytes, one buffer
    at a time, and puts the file in place by rename."""
    spark = lines.sparkSession
    parts = f"{path}.parts"
    lines.orderBy("pos").select(F.col("line").alias("value")).write.mode("overwrite").text(parts, lineSep=sep)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at = lambda p: hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    out = fs.create(at(f"{path}.tmp"), True)
    for name in sorted(s.getPath().toString() for s in fs.listStatus(at(parts)) if s.getPath().getName().startswith("part-")):
        part = fs.open(at(name))
        hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
        part.close()
    out.close()
    fs.delete(at(path), False)
    fs.rename(at(f"{path}.tmp"), at(path))
    fs.delete(at(parts), True)


def write_geojson(buildings: DataFrame, path: str, georeferenced: bool, **kw) -> None:
    """A feature collection in one file and line."""
    head = '"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},' if georeferenced else '"note":"NOT georeferenced: local metres",'
    spark = buildings.sparkSession
    f = geojson_features(buildings, **kw)
    first = f.agg(F.min("id")).first()[0]
    rows = f.select(F.struct(F.lit(1).alias("kind"), F.col("id").cast("long").alias("id")).alias("pos"), F.concat(F.when(F.col("id") == first, "").otherwise(","), "feature").alias("line"))
    ends = spark.createDataFrame([((0, 0), '{"type":"FeatureCollection",' + head + '"features":['), ((2, 0), "]}")], "pos struct<kind:int,id:long>, line string")
    write_text_file(rows.unionByName(ends), path, " ")


def ply_lines(points: DataFrame) -> DataFrame:
    """Text rows of an ASCII point cloud, four decimals: idx, line."""
    return points.select("idx", F.format_string("%.4f %.4f %.4f %d %d %d", *[F.col(c).cast("double") for c in "xyz"], *[F.coalesce(F.col(c), F.lit(255)).cast("int") for c in "rgb"]).alias("line"))


def write_ply(points: DataFrame, path: str) -> None:
    """An ASCII point cloud in one file, in order of idx."""
    head = f"ply\nformat ascii 1.0\nelement vertex {points.count()}\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header"
    rows = ply_lines(points).select(F.col("idx").cast("long").alias("pos"), "line")
    write_text_file(rows.unionByName(points.sparkSession.createDataFrame([(-(1 << 63), head)], "pos long, line string")), path)


def las_fields(points: DataFrame, x0: float, y0: float, z0: float, scale: float = 0.001) -> DataFrame:
    """Stored integers of a LAS record: offsets taken off, millimetres, colours times 257, class 0 where there is none."""
    q = lambda c, o: F.rint((F.col(c) - F.lit(o)) / scale).cast("int").alias(c)
    cls = F.col("class") if "class" in points.columns else F.lit(None)
    return points.select(q("x", x0), q("y", y0), q("z", z0), *[(F.coalesce(F.col(c), F.lit(0)) * 257).cast("int").alias(c) for c in "rgb"], F.coalesce(cls, F.lit(0)).cast("int").alias("class"))


def write_las(points: DataFrame, path: str) -> None:
    """LAS 1.4, point format 7, in one file. Points are numbered; tasks pack records and write them at their bytes."""
    box = points.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n")).first()
    off = [float(box[f"lo{c}"] or 0.0) for c in "xyz"]
    head = bytearray(375)
    head[0:4], head[24:26] = b"LASF", bytes((1, 4))
    struct.pack_into("<H", head, 94, 375)
    struct.pack_into("<IIBH", head, 96, 375, 0, 7, 36)
    struct.pack_into("<3d3d", head, 131, *[0.001] * 3, *off)
    struct.pack_into("<6d", head, 179, *[v for c in "xyz" for v in (float(box[f"hi{c}"] or 0.0), float(box[f"lo{c}"] or 0.0))])
    struct.pack_into("<QQ", head, 247, box["n"], box["n"])
    # The fields of a record, in order.
    record = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")]
    constant = {"intensity": 0, "returns": 0x11, "flags": 0, "user": 0, "angle": 0, "source": 0, "time": 0.0}
    rows = numbered_as_is(las_fields(points, *off))
    write_blocks(pack_records(rows, "i", record, len(head), constant), path, bytes(head), len(head) + 36 * box["n"])


def to_gltf(x, y, z) -> tuple:
    """East, north, up to right, up, back: (x, z, -y)."""
    return col(x).cast("float"), col(z).cast("float"), (-col(y)).cast("float")


def write_glb(vertices: DataFrame, faces: DataFrame, path: str, extras: dict | None = None) -> None:
    """A mesh container: vertices (vid, x, y, z), faces (v0, v1, v2); ids become positions in order of vid.

    Positions and faces are numbered; tasks pack them and write them at their bytes."""
    v = materialise(numbered(vertices.select("vid", *[c.alias(n) for c, n in zip(to_gltf("x", "y", "z"), "xyz")]), "vid", "i"))
    f = faces.select("v0", "v1", "v2")
    for c in ("v0", "v1", "v2"):
        f = f.join(v.select(F.col("vid").alias(c), (F.col("i") - 1).alias(f"i{c}")), c)
    f = numbered_as_is(f.select("iv0", "iv1", "iv2"))
    box = v.agg(F.count(F.lit(1)).alias("n"), *[g(c).alias(f"{k}{c}") for c in "xyz" for k, g in (("lo", F.min), ("hi", F.max))]).first()
    n, m = box["n"], f.count()
    doc = {
        "asset": {"version": "2.0", "extras": extras or {}}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "buffers": [{"byteLength": 12 * (n + m)}], "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 12 * n}, {"buffer": 0, "byteOffset": 12 * n, "byteLength": 12 * m}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": n, "type": "VEC3", "min": [box[f"lo{c}"] for c in "xyz"], "max": [box[f"hi{c}"] for c in "xyz"]}, {"bufferView": 1, "componentType": 5125, "count": 3 * m, "type": "SCALAR"}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    size = 12 * (n + m)
    head = struct.pack("<4sIIII", b"glTF", 2, 28 + len(text) + size, len(text), 0x4E4F534A) + text + struct.pack("<II", size, 0x004E4942)
    blocks = pack_records(v.withColumn("i", F.col("i") - 1), "i", [(c, "<f4") for c in "xyz"], len(head)).unionByName(pack_records(f, "i", [(c, "<u4") for c in ("iv0", "iv1", "iv2")], len(head) + 12 * n))
    write_blocks(blocks, path, head, len(head) + size)


def transform_obj(spark: SparkSession, path: str, scale: float, rotation, translation) -> DataFrame:
    """Lines of a mesh text file, vertices moved by a similarity, all others as they are: n, line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    f = F.split(F.trim("line"), r"\s+")
    xyz = [F.get(f, F.lit(i)).try_cast("double") for i in (1, 2, 3)]
    moved = apply_sim3(xyz, scale, rotation, translation)
    rest = F.array_join(F.slice(f, 5, F.greatest(F.size(f) - 4, F.lit(0))), " ")
    line = F.concat(F.format_string("v %.6f %.6f %.6f", *moved), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""))
    return lines.select("n", F.when(F.startswith("line", F.lit("v ")), line).otherwise(F.col("line")).alias("line"))


def transform_points(points: DataFrame, scale: float, rotation, translation) -> DataFrame:
    moved = apply_sim3(("x", "y", "z"), scale, rotation, translation)
    return points.withColumns(dict(zip("xyz", moved)))


def write_depth_array(depth: DataFrame, path: str, width: int, height: int, value: str = "depth") -> None:
    """Cells (row, col, value), each at most once, as a one-channel depth array; cells that are not listed, or null, are 0."""
    head = f"{width}&{height}&1&".encode()
    strips = depth.sparkSession.range(height).select(F.col("id").alias("row"))
    listed = depth.groupBy(F.col("row").cast("long").alias("row")).agg(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.coalesce(F.col(value), F.lit(0)).cast("float").alias("value"))).alias("cells"))

    def pack(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            out = np.zeros((len(b), width), "<f4")
            for k, cells in enumerate(b["cells"]):
                for c in cells if cells is not None else ():
                    out[k, c["col"]] = c["value"]
            yield pd.DataFrame({"pos": len(head) + 4 * width * b["row"], "data": [line.tobytes() for line in out]})

    blocks = strips.join(listed, "row", "left").mapInPandas(pack, "pos long, data binary")
    write_blocks(blocks, path, head, len(head) + 4 * width * height)


def write_raster(cells: DataFrame, path: str, nodata: float = -9999.0) -> None:
    """A raster as a table of cells, in row order by file; null becomes nodata. ``rasters.write_geotiff`` makes one image file."""
    cells.withColumn("value", F.coalesce("value", F.lit(nodata)).cast("float")).repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)
