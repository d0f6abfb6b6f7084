"""Headers, pixels and masks of image files."""

import struct
import zlib

import pytest

from aeroframe.session import ship
from aeroframe.sources import images


def entry(tag, kind, count, value):
    return struct.pack("<HHI", tag, kind, count) + value


def jpeg(lat, lon, alt, when, xmp=""):
    """The headers of a photo: enough for every reader but one of pixels."""
    at, body = 8 + 2 + 24 + 4, b""
    exif_at = at
    text = when.encode() + b"\0"
    text_at = exif_at + 2 + 24 + 4
    exif = struct.pack("<H", 2) + entry(images.CAPTURED, 2, len(text), struct.pack("<I", text_at)) + entry(images.FOCAL_35MM, 3, 1, struct.pack("<HH", 24, 0)) + struct.pack("<I", 0) + text
    gps_at = exif_at + len(exif)
    rational = lambda *v: b"".join(struct.pack("<II", int(x * 10000), 10000) for x in v)
    dms = lambda v: rational(int(v), int(v % 1 * 60), (v % 1 * 60) % 1 * 60)
    data_at = gps_at + 2 + 60 + 4
    gps = struct.pack("<H", 5) + entry(1, 2, 2, b"N\0\0\0" if lat >= 0 else b"S\0\0\0") + entry(2, 5, 3, struct.pack("<I", data_at)) + entry(3, 2, 2, b"E\0\0\0" if lon >= 0 else b"W\0\0\0") + entry(4, 5, 3, struct.pack("<I", data_at + 24)) + entry(6, 5, 1, struct.pack("<I", data_at + 48))
    gps += struct.pack("<I", 0) + dms(abs(lat)) + dms(abs(lon)) + rational(alt)
    tiff = struct.pack("<2sHIH", b"II", 42, 8, 2) + entry(images.EXIF_DIRECTORY, 4, 1, struct.pack("<I", exif_at)) + entry(images.GPS_DIRECTORY, 4, 1, struct.pack("<I", gps_at)) + struct.pack("<I", 0) + exif + gps + body
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + xmp.encode()


def png(rows):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_photos_as_a_clip(spark, tmp_path):
    ship(spark)
    places = {"b.jpg": (47.25, -8.5, 400.0, "2024:05:01 10:00:00"), "a.jpg": (-47.5, 8.125, 410.5, "2024:05:01 10:00:05"), "c.jpg": (47.0, 8.0, 399.0, "2024:05:01 09:59:00")}
    for name, p in places.items():
        (tmp_path / name).write_bytes(jpeg(*p, xmp='<x drone-dji:RelativeAltitude="+60.5" drone-dji:GimbalYawDegree="-12.5"/>'))
    (tmp_path / "no.jpg").write_bytes(b"\xff\xd8\xff\xd9")
    got = {r.name: r for r in images.read_exif(spark, str(tmp_path)).collect()}
    for name, (lat, lon, alt, _) in places.items():
        r = got[name]
        assert abs(r.lat - lat) < 1e-6 and abs(r.lon - lon) < 1e-6 and abs(r.abs_alt - alt) < 1e-3 and r.focal_35mm == 24 and r.captured.year == 2024
    assert got["no.jpg"].lat is None
    clip = images.photo_samples(spark, str(tmp_path), 2.0).orderBy("seq").collect()
    assert [(r.name, r.t) for r in clip] == [("c.jpg", 0.0), ("b.jpg", 0.5), ("a.jpg", 1.0)] and clip[0].rel_alt == 60.5 and clip[0].gimbal_yaw == -12.5
    with pytest.raises(ValueError):
        images.photo_samples(spark, str(tmp_path), least=9)


def test_masks(spark, tmp_path):
    ship(spark)
    (tmp_path / "m.png").write_bytes(png([[0, 200, 127], [128, 0, 255]]))
    got = {(r.image, r.row, r.col): r.dynamic for r in images.read_masks(spark, str(tmp_path)).collect()}
    assert got == {("m", 0, 0): False, ("m", 0, 1): True, ("m", 0, 2): False, ("m", 1, 0): True, ("m", 1, 1): False, ("m", 1, 2): True}
