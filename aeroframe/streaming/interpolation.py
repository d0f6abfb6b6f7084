"""Two-sided interpolation on streams: targets wait, with state and event-time timers, until both neighbours are certain."""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def between(samples: list, times: list, t: float, k: int):
    """Field ``k`` at time t from samples (t, seq, fields) in order; None without any. The last sample at or before t and the first at or after it count."""
    i = bisect.bisect_right(times, t) - 1
    while i >= 0 and samples[i][2][k] is None:
        i -= 1
    j = bisect.bisect_left(times, t)
    while j < len(samples) and samples[j][2][k] is None:
        j += 1
    a, b = samples[i] if i >= 0 else None, samples[j] if j < len(samples) else None
    if a is None or b is None:
        return None if a is b else (a or b)[2][k]
    span = b[0] - a[0]
    return a[2][k] if span == 0 else a[2][k] + (b[2][k] - a[2][k]) * (t - a[0]) / span


class Interpolator(StatefulProcessor):
    """Per key: the samples that a target can still need, and the targets that wait."""

    def __init__(self, keys: list[str], fields: list[str], patience: float):
        self.keys, self.fields, self.patience = keys, fields, patience

    def init(self, handle):
        self.handle = handle
        self.samples = handle.getListState("samples", T.StructType([T.StructField("t", T.DoubleType()), T.StructField("seq", T.LongType()), *[T.StructField(f"v{k}", T.DoubleType()) for k in range(len(self.fields))]]))
        self.waiting = handle.getListState("waiting", "t double, target string")

    def handleInputRows(self, key, rows, timerValues):
        samples, waiting = self._held(self.samples), self._held(self.waiting)
        for b in rows:
            for r in b.itertuples(index=False):
                if r.kind == 0:
                    samples.append((r.t, int(r.seq), *[None if pd.isna(v) else float(v) for v in (getattr(r, f"v{k}") for k in range(len(self.fields)))]))
                else:
                    waiting.append((r.t, r.target))
        yield self._settled(key, samples, waiting, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._settled(key, self._held(self.samples), self._held(self.waiting), timerValues)

    @staticmethod
    def _held(state) -> list:
        return [tuple(None if pd.isna(v) else v for v in x) for x in state.get()] if state.exists() else []

    def _settled(self, key, samples, waiting, timers) -> pd.DataFrame:
        """Gives out the targets whose neighbours no later row can change, and drops samples that none needs."""
        sure, n = timers.getCurrentWatermarkInMs() / 1000.0, len(self.fields)
        rows = sorted(((s[0], s[1], s[2:]) for s in samples), key=lambda s: s[:2])
        times = [r[0] for r in rows]
        out, left, wake = [], [], None
        for t, target in sorted(waiting):
            j, after = bisect.bisect_left(times, t), t
            for k in range(n):  # the first samples at or after t that have the fields
                after = max(after, next((r[0] for r in rows[j:] if r[2][k] is not None), math.inf))
            due = min(after, t + self.patience)
            if due <= sure:
                out.append((*key, target, t, *[between(rows, times, t, k) for k in range(n)]))
            else:
                left.append((t, target))
                wake = due if wake is None else min(wake, due)
        low = min([sure, *[t for t, _ in left]])
        first = bisect.bisect_right(times, low)
        needed = {max((i for i in range(first) if rows[i][2][k] is not None), default=first) for k in range(n)}
        keep = [r for i, r in enumerate(rows) if i >= first or i in needed]
        self.samples.put([(r[0], r[1], *r[2]) for r in keep]) if keep else self.samples.clear()
        self.waiting.put(left) if left else self.waiting.clear()
        if wake is not None:
            self.handle.registerTimer(math.ceil(wake * 1000) + 1)
        return pd.DataFrame(out, columns=[*self.keys, "target", "t", *self.fields])


def interpolate_stream(samples: DataFrame, targets: DataFrame, keys: list[str], fields: list[str], ts: str = "ts", seq: str = "seq", target: str = "target", late: str = "10 seconds", patience: float = 60.0) -> DataFrame:
    """Each target (keys, ts, target) with the fields between the samples (keys, ts, seq, fields) on both sides: keys, target, t (seconds), fields.

    A target is given out once, when the watermark has passed its later neighbour, or
    ``patience`` seconds after it where none has come; then it takes the last value.
    Rows later than ``late`` are dropped. Where samples are never further apart than
    the patience, the stream gives what ``interpolate.interpolate_fields`` gives for the
    whole tables. A key holds the samples from the last one before what is still
    open, whatever has passed. The session keeps state in RocksDB from here on."""
    spark = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = (F.unix_micros(ts) / 1e6).alias("t")
    s = samples.withWatermark(ts, late).select(*keys, ts, at, F.lit(0).alias("kind"), F.col(seq).cast("long").alias("seq"), F.lit(None).cast("string").alias("target"), *[F.col(f).cast("double").alias(f"v{k}") for k, f in enumerate(fields)])
    w = targets.withWatermark(ts, late).select(*keys, ts, at, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), F.col(target).cast("string").alias("target"), *[F.lit(None).cast("double").alias(f"v{k}") for k in range(len(fields))])
    out = T.StructType([*[T.StructField(k, samples.schema[k].dataType) for k in keys], T.StructField("target", T.StringType()), T.StructField("t", T.DoubleType()), *[T.StructField(f, T.DoubleType()) for f in fields]])
    return s.unionByName(w).groupBy(*keys).transformWithStateInPandas(Interpolator(keys, fields, patience), out, "Append", "EventTime")
