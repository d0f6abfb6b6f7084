"""Dense depth from neighbouring frames: planes swept through the scene, costs aggregated along image lines.

An image and the few neighbours it is matched with are one group, which gives every pixel
its cost at every plane, the planes being parallel to the image and even in inverse depth.
Costs are then aggregated along lines in four directions; along a line, both ways, a step to
the next plane costs little and a jump more. An image of at most VOLUME costs is finished where
they were made, many small ones in one go. The costs of a larger one go to bands of lines;
bands are groups of bounded size, so images are cut into as many as they need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .joins import dealt
from .tracking import sample

#: Side of the window over which squared differences are averaged, their greatest value, lines of a band, rows projected at a time.
WINDOW, CAP, BAND, STRIP = 5, 400.0, 32, 32
#: Costs of a step to the next plane and of any jump.
STEP, JUMP = 2.0, 60.0
#: Costs of an image that is aggregated where they were made, and of the images that are aggregated in one go.
VOLUME, BATCH = 1 << 24, 1 << 20
_CAMERA = ("fx", "fy", "cx", "cy", "r_cw", "t_cw")


def inverse_depths(near: float, far: float, planes: int) -> np.ndarray:
    return np.linspace(1 / far, 1 / near, planes)


def _box(a: np.ndarray, side: int) -> np.ndarray:
    """Means over windows of the first two axes; borders repeat."""
    half = side // 2
    for axis in (0, 1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (half + 1, half)
        s = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = a.shape[axis]
        a = (np.take(s, np.arange(side, n + side), axis) - np.take(s, np.arange(n), axis)) / side
    return a


def plane_costs(ref: dict, others: list[dict], inverse: np.ndarray) -> np.ndarray:
    """(height, width, planes): the windowed squared difference to the neighbours, the better half of those that see the point; CAP where none does."""
    image = lambda r: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]).astype(np.float32)
    pose = lambda r: (np.array(r["r_cw"]).reshape(3, 3), np.array(r["t_cw"]))
    a, (r0, t0) = image(ref), pose(ref)
    h, w = a.shape
    each = []
    for o in others:
        b, (r1, t1) = image(o), pose(o)
        turn = r1 @ r0.T
        shift = t1 - turn @ t0
        off = np.empty((h, w, len(inverse)), np.float32)
        for top in range(0, h, STRIP):
            v, u = np.mgrid[top : min(h, top + STRIP), 0:w] + 0.5
            ray = np.stack([(u - ref["cx"]) / ref["fx"], (v - ref["cy"]) / ref["fy"], np.ones_like(u)], axis=-1) @ turn.T
            p = ray[:, :, None, :] + inverse[None, None, :, None] * shift  # the point divided by its depth
            front = p[..., 2] > 1e-6
            z = np.where(front, p[..., 2], 1.0)
            x, y = o["fx"] * p[..., 0] / z + o["cx"] - 0.5, o["fy"] * p[..., 1] / z + o["cy"] - 0.5
            seen = front & (x >= 0) & (x <= b.shape[1] - 1) & (y >= 0) & (y <= b.shape[0] - 1)
            d = sample(b, x, y) - a[top : top + len(v), :, None]
            off[top : top + len(v)] = np.where(seen, np.minimum(d * d, CAP), CAP)
        each.append(_box(off, WINDOW))
    best = np.sort(np.stack(each), axis=0)
    return best[: max(1, len(each) // 2)].mean(axis=0).astype(np.float32)


def along_lines(cost: np.ndarray, length: np.ndarray, step: float = STEP, jump: float = JUMP) -> np.ndarray:
    """(lines, positions, planes) of costs, each line of its own length: aggregated from both ends, added up, the cost itself once."""
    out = -cost.astype(np.float64)
    lines = np.arange(len(cost))
    for backward in (False, True):
        last = None
        for k in range(cost.shape[1]):
            at = (length - 1 - k) if backward else np.full(len(cost), k)
            live = (at >= 0) & (at < length)
            c = cost[lines, np.clip(at, 0, None)].astype(np.float64)
            if last is not None:
                least = last.min(axis=1, keepdims=True)
                near = np.pad(last, ((0, 0), (1, 1)), constant_values=np.inf)
                c = c + np.minimum(np.minimum(last, least + jump), np.minimum(near[:, :-2], near[:, 2:]) + step) - least
            out[lines[live], at[live]] += c[live]
            last = c
    return out


def _aggregated(cost: np.ndarray, step: float, jump: float) -> np.ndarray:
    """(images, height, width, planes) of costs, summed up over the lines of four directions."""
    n, h, w, planes = cost.shape
    row, col = np.indices((h, w)).reshape(2, -1)
    total = np.zeros((n, h * w, planes), np.float32)
    for line, pos in ((row, col), (col, row), (row - col, col), (row + col, col)):
        order = np.lexsort((pos, line))
        _, begin, length = np.unique(line[order], return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(begin)), length), np.arange(h * w) - np.repeat(begin, length)
        c = np.zeros((n, len(begin), length.max(), planes), np.float32)
        c[:, at[0], at[1]] = cost.reshape(n, h * w, planes)[:, order]
        done = along_lines(c.reshape(-1, *c.shape[2:]), np.tile(length, n), step, jump).reshape(c.shape)
        total[:, order] += done[:, at[0], at[1]].astype(np.float32)
    return total.reshape(cost.shape)


def _depths(total: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(depth, cost) of summed costs (pixels, planes): the cheapest plane, the first of equals, moved by a parabola through its neighbours."""
    k = total.argmin(axis=1)
    at = lambda i: total[np.arange(len(k)), np.clip(k + i, 0, total.shape[1] - 1)].astype(np.float64)
    bend = np.where((k > 0) & (k < total.shape[1] - 1), at(-1) + at(1) - 2 * at(0), 0.0)
    shift = np.where(bend > 0, (at(-1) - at(1)) / (2 * np.where(bend > 0, bend, 1.0)), 0.0)
    return 1 / (inverse[0] + (k + shift) * (inverse[1] - inverse[0])), at(0)


def dense_depth(frames: DataFrame, pairs: DataFrame, near: float, far: float, planes: int = 64, step: float = STEP, jump: float = JUMP) -> DataFrame:
    """image, row, col, z, cost: each pixel's depth along the image's axis, between planes by a parabola.

    Frames: image, height, width, pixels (8 bits), fx, fy, cx, cy, r_cw, t_cw. Pairs: image,
    other, the few neighbours an image is matched with. Images without pairs give nothing.
    Frames are read more than once, so they should be a written table."""
    inverse = inverse_depths(near, far, planes)
    fields = ["height", "width", "pixels", *_CAMERA]
    serve = pairs.select("image", "other").unionByName(pairs.select("image", F.col("image").alias("other"))).distinct()
    rows = serve.join(frames.select(F.col("image").alias("other"), *fields), "other")
    large = frames.where(F.col("height").cast("long") * F.col("width") * planes > VOLUME).select("image")
    kind = T.StructType([frames.schema["image"], *[T.StructField(c, t) for c, t in (("row", T.IntegerType()), ("col", T.IntegerType()), ("z", T.DoubleType()), ("cost", T.DoubleType()))]])

    def finish(batches):
        """Images one after the other, their rows together; a batch may end inside an image."""
        held, made, image = [], [], None

        def told():
            while made:
                shape = made[0][1].shape
                some = [m for m in made if m[1].shape == shape]
                made[:] = [m for m in made if m[1].shape != shape]
                z, cost = _depths(_aggregated(np.stack([c for _, c in some]), step, jump).reshape(-1, planes), inverse)
                v, u = np.tile(np.indices(shape[:2], np.int32).reshape(2, 1, -1), (1, len(some), 1)).reshape(2, -1)
                ids = pa.array([i for i, _ in some], image).take(pa.array(np.repeat(np.arange(len(some)), shape[0] * shape[1])))
                yield pa.record_batch([ids, pa.array(v), pa.array(u), pa.array(z), pa.array(cost)], ["image", "row", "col", "z", "cost"])

        def match():
            ref, others = [r for r in held if r["other"] == r["image"]], [r for r in held if r["other"] != r["image"]]
            held.clear()
            if ref and others:
                made.append((ref[0]["image"], plane_costs(ref[0], others, inverse)))

        for b in batches:
            image = b.schema.field("image").type
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if held and r["image"] != held[0]["image"]:
                    match()
                    if sum(c.size for _, c in made) >= BATCH:
                        yield from told()
                held.append(r)
        match()
        yield from told()

    some_large = not large.isEmpty()
    small = rows.join(large, "image", "left_anti") if some_large else rows
    out = dealt(small, "image").sortWithinPartitions("image", "other").mapInArrow(finish, kind)
    return out.unionByName(_in_bands(rows.join(large, "image", "left_semi"), frames, inverse, step, jump)) if some_large else out


def _in_bands(rows: DataFrame, frames: DataFrame, inverse: np.ndarray, step: float, jump: float) -> DataFrame:
    """Images of any size, given with their neighbours' rows: bands of lines are groups."""
    planes, groups = len(inverse), rows.groupBy("image")
    kind = T.StructType([frames.schema["image"], *[T.StructField(c, T.IntegerType()) for c in ("row", "col")], T.StructField("costs", T.ArrayType(T.FloatType()))])

    def lists(a: np.ndarray, t) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1), t))

    def match(key, group):
        rows = sorted(group.to_pylist(), key=lambda r: r["other"])
        ref, others = [r for r in rows if r["other"] == r["image"]], [r for r in rows if r["other"] != r["image"]]
        if not ref or not others:
            return pa.table({"image": pa.array([], group.schema.field("image").type), "row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "costs": pa.array([], pa.list_(pa.float32()))})
        c = plane_costs(ref[0], others, inverse)
        v, u = np.indices(c.shape[:2], np.int32).reshape(2, -1)
        return pa.table({"image": pa.array([ref[0]["image"]] * len(v), group.schema.field("image").type), "row": v, "col": u, "costs": lists(c.reshape(-1, planes), pa.float32())})

    costs = materialise(groups.applyInArrow(match, kind))
    row, col = F.col("row"), F.col("col")
    ways = [(0, row, col), (1, col, row), (2, row - col, col), (3, row + col, col)]
    line = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), a.alias("line"), b.alias("pos")) for w, a, b in ways])).alias("l")
    sent = costs.select("*", line).select("image", "row", "col", "costs", "l.way", "l.line", "l.pos", F.floor(F.col("l.line") / BAND).alias("band"))

    def aggregate(key, group):
        lines, pos = group.column("line").to_numpy(), group.column("pos").to_numpy()
        order = np.lexsort((pos, lines))
        names, begin, length = np.unique(lines[order], return_index=True, return_counts=True)
        flat = group.column("costs").combine_chunks().flatten().to_numpy().reshape(-1, planes)[order]
        at = np.repeat(np.arange(len(names)), length), np.arange(len(order)) - np.repeat(begin, length)
        c = np.zeros((len(names), length.max(), planes), np.float32)
        c[at] = flat
        total = along_lines(c, length, step, jump)[at]
        take = group.take(pa.array(order))
        return pa.table({"image": take.column("image"), "row": take.column("row"), "col": take.column("col"), "costs": lists(total.astype(np.float32), pa.float32())})

    done = sent.groupBy("image", "way", "band").applyInArrow(aggregate, kind)
    added = F.reduce(F.collect_list("costs"), F.array_repeat(F.lit(0.0).cast("float"), planes), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    total = done.groupBy("image", "row", "col").agg(added.alias("c"))
    total = total.select("*", F.explode(F.array(F.array_position("c", F.array_min("c")).cast("int") - 1)).alias("k"))
    at = lambda i: F.get("c", F.col("k") + i).cast("double")
    bend = at(-1) + at(1) - 2 * at(0)
    shift = F.when(bend > 0, (at(-1) - at(1)) / (2 * bend)).otherwise(0.0)
    gap = float(inverse[1] - inverse[0])
    return total.select("image", "row", "col", (1 / (F.lit(float(inverse[0])) + (F.col("k") + F.coalesce(shift, F.lit(0.0))) * gap)).alias("z"), at(0).alias("cost"))
