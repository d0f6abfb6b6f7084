"""Live telemetry by Structured Streaming: parsing, windows, segments, key frames with state.

Rows behind the watermark are dropped; run over the same rows with nothing late,
every stream equals its batch form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.telemetry import blocks, parse_blocks, strip_tags, usable


def srt_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """New subtitle files of a folder as samples."""
    text = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder)
    rows = text.select(strip_tags(F.col("value")).alias("text")).select(F.explode(blocks(F.col("text"))).alias("block"))
    return usable(parse_blocks(rows))


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts, sums and means by tumbling or sliding window; works on tables too, where the watermark has no effect."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = e.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total", "mean")


def segments(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Flight segments: sessions without a gap."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    out = e.groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def stream_keyframes(frames: DataFrame, key: str, min_disp: float = 40.0, max_gap: float = 2.0) -> DataFrame:
    """Key frames of live clips: key, frame_index. State per clip is four numbers. Frames: key, frame_index, t, sharp, step_px.

    Frames of a clip must arrive in order from batch to batch; inside one they are sorted."""

    def step(k, batches, state):
        last, disp, pending, any_ = state.get if state.exists else (0.0, 0.0, False, False)
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        for i, t, sharp, px in zip(rows["frame_index"], rows["t"], rows["sharp"], rows["step_px"]):
            if not any_:
                if sharp:
                    out.append(i)
                    last, any_ = t, True
                continue
            disp += px
            pending = pending or disp >= min_disp or t - last >= max_gap
            if pending and sharp:
                out.append(i)
                last, disp, pending = t, 0.0, False
        state.update((float(last), float(disp), bool(pending), bool(any_)))
        yield pd.DataFrame({key: [k[0]] * len(out), "frame_index": out})

    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, frame_index long", "last double, disp double, pending boolean, started boolean", "append", "NoTimeout")


def run_once(df: DataFrame, checkpoint: str, write) -> None:
    """Process what is there and stop; ``write(batch, id)`` gets every micro-batch and should be idempotent by id."""
    df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
