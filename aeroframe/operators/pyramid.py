"""Hole filling over a pyramid of halved grids, and area averages of images at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .joins import sorted_join


def fill_pyramid(cells: DataFrame, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Holes of any width filled smoothly from the cells around them; known cells stay as they are.

    Cells: keys, row, col (0 or more), value, null in holes; one a place. Only listed
    cells are filled. Means are pulled up through grids of half the size until one cell
    is left, each with the share it knows, and pushed down again: what a cell lacks
    comes from the four nearest cells of the coarser grid. A level is one grouping of a
    quarter of the rows before, and cells know nothing of tiles, so there are no seams.
    Keys without any known cell stay null; columns other than these are dropped."""
    at = [*keys, "row", "col"]
    levels = [cells.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v"), F.when(F.col(value).isNull(), 0.0).otherwise(1.0).alias("w"))]
    top = cells.agg(F.max(F.greatest("row", "col"))).first()[0] or 0
    for _ in range(int(top).bit_length()):
        halved = levels[-1].groupBy(*keys, F.shiftright("row", 1).alias("row"), F.shiftright("col", 1).alias("col"))
        got = halved.agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("n"))
        levels.append(materialise(got.select(*at, F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("v"), F.least(F.lit(1.0), "n").alias("w"))))
    full = levels[-1].select(*at, "v")
    for level in reversed(levels[:-1]):
        whole = level.where("w >= 1").select(*at, "v")
        # The cell's own parent and the nearer neighbours of that, by their distance: 9, 3, 3 and 1 sixteenths.
        near = lambda c: F.array(*[F.struct((F.shiftright(c, 1) + d).alias("at"), F.lit(w).alias("w")) for d, w in ((0, 0.75), (F.when(F.col(c) % 2 == 1, 1).otherwise(-1), 0.25))])
        asked = level.where("w < 1").withColumn("pr", F.explode(near("row"))).withColumn("pc", F.explode(near("col")))
        asked = asked.select(*keys, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("v").alias("v0"), F.col("w").alias("w0"), F.col("pr.at").alias("row"), F.col("pc.at").alias("col"), (F.col("pr.w") * F.col("pc.w")).alias("share"))
        given = sorted_join(asked, full, at).where("v IS NOT NULL").groupBy(*keys, "r0", "c0").agg((F.sum(F.col("share") * F.col("v")) / F.sum("share")).alias("up"), F.first("v0").alias("v0"), F.first("w0").alias("w0"))
        mended = given.select(*keys, F.col("r0").alias("row"), F.col("c0").alias("col"), (F.col("w0") * F.coalesce("v0", F.lit(0.0)) + (1 - F.col("w0")) * F.col("up")).alias("v"))
        full = whole.unionByName(mended)
    out = cells.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    return sorted_join(out, full, at, "left").select(*at, F.col("v").alias(value))


def resize_area(pixels: DataFrame, sizes: DataFrame, most: int, values: tuple[str, ...] = ("value",), key: str = "image") -> DataFrame:
    """Images scaled down so that their longer side is ``most``: each new pixel is the mean of what it covers, shares of pixels included. Smaller images stay.

    Pixels: key, row, col, values; sizes: key, height, width. New sizes are rounded down."""
    long = F.greatest("height", "width")
    s = sizes.select(key, *[F.when(long > most, F.greatest(F.floor(F.col(c) * most / long), F.lit(1))).otherwise(F.col(c)).cast("long").alias(f"new_{c}") for c in ("height", "width")], "height", "width")
    p = pixels.join(s.hint("shuffle_hash"), key)
    for c, side in (("row", "height"), ("col", "width")):
        step = F.col(side) / F.col(f"new_{side}")
        first = F.floor(F.col(c) / step + 1e-9)
        last = F.least(F.ceil((F.col(c) + 1) / step - 1e-9), F.col(f"new_{side}")) - 1
        p = p.withColumn(f"n{c}", F.explode(F.sequence(first, F.greatest(first, last))))
        p = p.withColumn(f"w{c}", F.least(F.col(c) + 1, (F.col(f"n{c}") + 1) * step) - F.greatest(F.col(c).cast("double"), F.col(f"n{c}") * step))
    w = F.col("wrow") * F.col("wcol")
    return p.groupBy(key, F.col("nrow").alias("row"), F.col("ncol").alias("col")).agg(*[(F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values])
