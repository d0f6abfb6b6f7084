"""Time series: two-sided interpolation, angle unwrapping, span tests, gaps, buckets, decimation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import wrap_degrees


def unwrap_degrees(df: DataFrame, value: str, keys: list[str], order: list[str], out: str | None = None) -> DataFrame:
    """Adds whole turns so that steps lie from minus half a turn to below half a turn; the first value of each key stays, nulls are stepped over.

    A step of exactly half a turn, which is as far either way, goes down."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.col(value) - F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fix = F.when(F.abs(step) < 180, 0.0).otherwise(wrap_degrees(step) - step)
    return df.withColumn("__fix", F.coalesce(fix, F.lit(0.0))).withColumn(out or value, F.col(value) + F.sum("__fix").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fix")


def interpolate(samples: DataFrame, targets: DataFrame, keys: list[str], value: str, t: str = "t", seq: str = "seq", angle: bool = False) -> DataFrame:
    """Each target row with ``value`` interpolated linearly between the samples on both sides of its time, clamped at both ends."""
    return interpolate_fields(samples, targets, keys, {value: angle}, t, seq)


def interpolate_fields(samples: DataFrame, targets: DataFrame, keys: list[str], fields: dict[str, bool], t: str = "t", seq: str = "seq") -> DataFrame:
    """``interpolate`` for several fields at once; ``fields`` tells of each whether it is an angle that wraps.

    Samples and targets are one sorted stream per key, whatever the number of
    fields: a target takes the last sample at or before it and the first one at or
    after it that have the field, so nothing is compared pairwise. Null and NaN
    values are left out; of samples at one time the last by ``seq`` counts on the
    left and the first on the right. A key without samples gives null."""
    given = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f"__v_{f}")
    s = samples.select(*keys, F.col(t).cast("double").alias("__t"), F.col(seq).cast("long").alias("__seq"), *map(given, fields))
    for f, angle in fields.items():
        if angle:
            s = unwrap_degrees(s, f"__v_{f}", keys, ["__t", "__seq"])
    extra = [c for c in targets.columns if c not in keys and c not in fields]
    k = targets.select(*keys, F.col(t).cast("double").alias("__t"), F.struct(*extra).alias("__row"), F.lit(1).alias("__kind"))
    both = s.withColumn("__kind", F.lit(0)).unionByName(k, allowMissingColumns=True)
    left = Window.partitionBy(*keys).orderBy("__t", "__kind", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy(*keys).orderBy(F.col("__t").desc(), "__kind", F.col("__seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    point = lambda f: F.when(F.col(f"__v_{f}").isNotNull(), F.struct("__t", F.col(f"__v_{f}").alias("__v")))
    both = both.withColumns({f"__a_{f}": F.last(point(f), ignorenulls=True).over(left) for f in fields}).withColumns({f"__b_{f}": F.last(point(f), ignorenulls=True).over(right) for f in fields}).where("__kind = 1")
    out = {f: linear(F.col("__t"), F.col(f"__a_{f}"), F.col(f"__b_{f}")) for f in fields}
    return both.select(*keys, "__row.*", *[(wrap_degrees(out[f]) if angle else out[f]).alias(f) for f, angle in fields.items()])


def linear(t: Column, a: Column, b: Column) -> Column:
    """Between two (t, v) points, either of which may be missing."""
    span = b["__t"] - a["__t"]
    between = a["__v"] + (b["__v"] - a["__v"]) * (t - a["__t"]) / F.when(span != 0, span)
    return F.when(a.isNull(), b["__v"]).when(b.isNull() | (span == 0), a["__v"]).otherwise(between)


def spans(samples: DataFrame, keys: list[str], t: str = "t", slack: float = 0.5) -> DataFrame:
    """First and last sample time of each key, widened by the slack."""
    return samples.groupBy(*keys).agg((F.min(t) - slack).alias("span_from"), (F.max(t) + slack).alias("span_to"))


def rebased(samples: DataFrame, targets: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Time-of-day captions (first sample after 1000 s) against clip times (last target before 1000 s): samples restart at 0."""
    lo = samples.groupBy(*keys).agg(F.min(t).alias("__t0"))
    hi = targets.groupBy(*keys).agg(F.max(t).alias("__t1"))
    cut = lo.join(hi, keys).select(*keys, F.when((F.col("__t0") > 1000) & (F.col("__t1") < 1000), F.col("__t0")).otherwise(0.0).alias("__cut"))
    return samples.join(cut, keys, "left").withColumn(t, F.col(t) - F.coalesce("__cut", F.lit(0.0))).drop("__cut")


# Fields, decimals and whether they are angles that wrap.
SYNC_FIELDS = {"lat": (8, False), "lon": (8, False), "abs_alt": (4, False), "rel_alt": (4, False), "gimbal_yaw": (4, True), "gimbal_pitch": (4, False), "gimbal_roll": (4, True), "focal_len": (4, False)}


def synchronise(samples: DataFrame, frames: DataFrame, keys: list[str], offset: float = 0.0, wrap_angles: bool = True) -> DataFrame:
    """Telemetry at every frame: keys, name, t, in_span, the fields, alt and alt_source.

    Frames need ``name`` and ``t``; samples t, seq and the fields."""
    out = frames.select(*keys, "name", (F.col("t") + offset).alias("t"))
    samples = rebased(samples, out, keys)
    ends = spans(samples, keys)
    out = interpolate_fields(samples, out, keys, {f: angle and wrap_angles for f, (_, angle) in SYNC_FIELDS.items()})
    out = out.join(ends, keys, "left").withColumn("in_span", F.coalesce(F.col("t").between(F.col("span_from"), F.col("span_to")), F.lit(False)))
    out = out.select(*keys, "name", F.bround("t", 4).alias("t"), "in_span", *[F.bround(f, d).alias(f) for f, (d, _) in SYNC_FIELDS.items()])
    source = F.when(F.col("abs_alt").isNotNull(), "abs_alt").when(F.col("rel_alt").isNotNull(), "rel_alt").otherwise("none")
    return out.withColumns({"alt": F.coalesce("abs_alt", "rel_alt"), "alt_source": source})


def gap_islands(df: DataFrame, keys: list[str], x: str, gap: float, out: str = "island") -> DataFrame:
    """Numbers runs of sorted values whose steps do not exceed ``gap``, from 1."""
    w = Window.partitionBy(*keys).orderBy(x)
    return df.withColumn(out, 1 + F.sum(F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("int"), F.lit(0))).over(w))


def bucket_best(df: DataFrame, keys: list[str], t: str, width: float, score: str, name: str) -> DataFrame:
    """The row of highest score in every time bucket, the smaller name on ties: keys, bucket, name, score."""
    b = F.floor(F.col(t) / width).alias("bucket")
    return df.groupBy(*keys, b).agg(F.max_by(F.struct(name, score), F.struct(score, F.negative(name))).alias("best")).select(*keys, "bucket", "best.*")


def decimate(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spread in order with both ends; halves round to even."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    # Row i stays if it is the nearest to one of the evenly spaced positions j * (n - 1) / (most - 1).
    step = (F.col("__n") - 1) / F.lit(max(most - 1, 1))
    j = F.rint(F.col("__i") / step)
    hit = F.rint(j * step) == F.col("__i")
    return df.where((F.col("__n") <= most) | hit).drop("__i", "__n")


def central_windows(df: DataFrame, keys: list[str], order: list[str], size: int, stride: int) -> DataFrame:
    """Sliding windows over an ordered clip, the last one flush with its end; every frame keeps the window in which it is most central."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({"i": F.row_number().over(w.orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(w)})
    last = F.greatest(F.col("n") - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    holds = F.filter(starts, lambda s: (F.col("i") >= s) & (F.col("i") < s + size))
    best = F.array_min(F.transform(holds, lambda s: F.struct(F.abs(2 * F.col("i") - 2 * s - (F.least(F.lit(size), F.col("n")) - 1)).alias("off"), s.alias("start"))))
    return df.withColumn("window_start", best["start"]).drop("i", "n")


def interval_counts(left: DataFrame, right: DataFrame, keys: list[str], start: str, t: str, seconds: int, id_col: str) -> DataFrame:
    """id, n: how many right rows of its keys lie within so many seconds after each left row.

    Both sides are dealt to time slots of the interval's length, a left row to two of
    them, so the join is an equi-join on keys and slot and no key is one group."""
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    far = F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    a = left.select(*keys, id_col, F.col(start).alias("__from"), F.explode(F.array(slot(start), slot(start) + 1)).alias("__slot"))
    b = right.select(*keys, F.col(t).alias("__t"), slot(t).alias("__slot"))
    hit = a.join(b, [*keys, "__slot"]).where((F.col("__t") >= F.col("__from")) & (F.col("__t") < F.col("__from") + far))
    n = hit.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return left.select(id_col).join(n, id_col, "left").select(id_col, F.coalesce("n", F.lit(0)).alias("n"))
