"""Contrast-limited histogram equalisation by tiles, over tables of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colour import lab_to_rgb, rgb_to_lab
from .joins import sorted_join

LEVELS = 256


def tile_curves(pixels: DataFrame, sizes: DataFrame, clip: float, tiles: int = 8, value: str = "value", key: str = "image") -> DataFrame:
    """key, trow, tcol, curve: the new value of each of 256 levels in each tile.

    An image is mirrored at its right and lower side until tiles divide it. Counts of
    a tile above the limit are taken off and shared out evenly, what is left over one
    each at even steps; the curve is their running sum scaled to 255."""
    s = sizes.select(key, *[F.col(c).cast("long").alias(c) for c in ("height", "width")])
    p = pixels.join(s.hint("shuffle_hash"), key)
    for c, side in (("row", "height"), ("col", "width")):
        n = F.col(side)
        p = p.withColumn(f"t{side}", F.ceil(n / tiles))
        again = 2 * n - 2 - F.col(c)
        copies = F.when((again < F.col(f"t{side}") * tiles) & (again >= n), F.array(F.col(c).cast("long"), again)).otherwise(F.array(F.col(c).cast("long")))
        p = p.withColumn(f"t{c}", F.explode(copies)).withColumn(f"t{c}", F.floor(F.col(f"t{c}") / F.col(f"t{side}")))
    n = p.groupBy(key, "trow", "tcol", F.col(value).cast("int").alias("level"), (F.col("theight") * F.col("twidth")).alias("area")).agg(F.count(F.lit(1)).alias("n"))
    tile = n.groupBy(key, "trow", "tcol", "area").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("counts"))
    limit = F.greatest(F.lit(1), F.floor(F.col("area") * clip / LEVELS))
    tile = tile.withColumn("limit", limit)
    held = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0).cast("long")))
    tile = tile.withColumn("held", held).withColumn("over", F.aggregate("held", F.lit(0).cast("long"), lambda a, n: a + F.greatest(n - F.col("limit"), F.lit(0))))
    tile = tile.withColumn("rest", F.col("over") % LEVELS).withColumn("step", F.greatest(F.floor(F.lit(LEVELS) / F.greatest("rest", F.lit(1))), F.lit(1)))
    shared = F.transform("held", lambda n, i: F.least(n, F.col("limit")) + F.floor(F.col("over") / LEVELS) + F.when((i % F.col("step") == 0) & (F.floor(i / F.col("step")) < F.col("rest")), 1).otherwise(0))
    tile = tile.withColumn("shared", shared)
    # Running sums: the sum so far stands behind the sums.
    sums = F.aggregate("shared", F.array().cast("array<long>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    curve = F.transform(sums, lambda v: F.least(F.rint(v * 255.0 / F.col("area")), F.lit(255.0)).cast("int"))
    return tile.select(key, "trow", "tcol", curve.alias("curve"))


def equalise(pixels: DataFrame, sizes: DataFrame, clip: float = 2.0, tiles: int = 8, value: str = "value", key: str = "image") -> DataFrame:
    """Pixels with their value on the blend of the curves of the four nearest tile centres. Pixels: key, row, col, value (0 to 255); sizes: key, height, width.

    The four curves of a patch between centres stand in one row, so a pixel is joined once."""
    curves = tile_curves(pixels, sizes, clip, tiles, value, key)

    def patches_of(tile):
        """Patches that a tile takes part in, as the later or the earlier one along an axis; tiles at a side are both there."""
        some = [(tile == 0, 0, 0), (tile == tiles - 1, tiles, 1), (F.lit(True), tile, 1), (F.lit(True), tile + 1, 0)]
        return F.explode(F.array_distinct(F.filter(F.array(*[F.when(c, F.struct(F.lit(at).cast("long").alias("at") if isinstance(at, int) else at.cast("long").alias("at"), F.lit(late).alias("late"))) for c, at, late in some]), lambda x: x.isNotNull())))

    sent = curves.withColumn("i", patches_of(F.col("trow"))).withColumn("j", patches_of(F.col("tcol"))).select(key, "curve", F.col("i.at").alias("prow"), F.col("j.at").alias("pcol"), (2 * F.col("i.late") + F.col("j.late")).alias("corner"))
    patches = sent.groupBy(key, "prow", "pcol").agg(*[F.max(F.when(F.col("corner") == k, F.col("curve"))).alias(f"curve{k}") for k in range(4)])
    s = sizes.select(key, *[F.col(c).cast("long").alias(c) for c in ("height", "width")])
    p = pixels.join(s.hint("shuffle_hash"), key)
    for c, side, name in (("row", "height", "prow"), ("col", "width", "pcol")):
        at = F.col(c) / F.ceil(F.col(side) / tiles) - 0.5
        p = p.withColumn(f"__f{c}", at - F.floor(at)).withColumn(name, F.floor(at) + 1)
    p = sorted_join(p, patches, [key, "prow", "pcol"])
    on = lambda k: F.get(F.col(f"curve{k}"), F.col(value).cast("int"))
    fr, fc = F.col("__frow"), F.col("__fcol")
    blend = (on(0) * (1 - fc) + on(1) * fc) * (1 - fr) + (on(2) * (1 - fc) + on(3) * fc) * fr
    return p.withColumn(value, F.rint(blend).cast("int")).select(*pixels.columns)


def enhanced(pixels: DataFrame, sizes: DataFrame, clip: float = 2.0, tiles: int = 8, key: str = "image") -> DataFrame:
    """Colour images (key, row, col, r, g, b) with their lightness equalised and their hues kept."""
    light, a, b = rgb_to_lab("r", "g", "b")
    lab = pixels.select(key, "row", "col", F.rint(light * 2.55).cast("int").alias("value"), a.alias("__a"), b.alias("__b"))
    out = equalise(lab, sizes, clip, tiles, "value", key)
    r, g, b = lab_to_rgb(F.col("value") / 2.55, F.col("__a"), F.col("__b"))
    return out.select(key, "row", "col", r.alias("r"), g.alias("g"), b.alias("b"))
