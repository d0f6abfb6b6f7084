"""Vector code compression: product codes by k-means on integers, with norm-of-sum bounds.

Each part of a vector keeps two bounds with the round at which each was taken: the exact
distance to its entry, and that to the nearest other entry. The codebooks of all rounds
are kept, 16 entries a part and round, so a bound of any age is moved by the true net
displacement of entries since its round, which is never more than the drifts of single
rounds added up. Where the moved bounds still part, the assignment stands; else the first
bound is taken anew, and only if that does not part them, all entries are compared.

A bound only skips work when it parts strictly and beyond the error of its square root,
so assignments, ties included, are those of a full comparison. A round is one pass that
writes vectors, codes and bounds, and rows of sums by task; those sums, one number an
entry and component, are all that the driver reads.

Defined results: vectors that are null, empty, hold null or non-finite components, or
differ in length from that of the smallest id take no part and have no row; a length
that 8 does not divide is filled up with zeros; fewer than 16 vectors make as many
entries; rows without an id come after all ids, rows that repeat one in the order of
their vectors; where components are so great that an error could exceed 62 bits, all are compared
without bounds in integers of any size, and an error above 64 bits is null, as is the sum of a label that holds it; an empty
table gives an empty table; input columns named like the output are replaced, others kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_folder, even_join, materialise, shared_dir, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums are sent to all tasks; more are joined.
BROADCAST_LABELS = 100_000
#: A sum of any size travels as this many digits of 32 bits, the last one signed.
DIGITS = 36
_FAR = 2**62
_STATE = ["code", "near", "next", "near_at", "next_at"]


def squared(x, c):
    """Squared distances of rows to entries."""
    d = x[:, None, :] - c[None, :, :]
    return (d * d).sum(axis=2)


def nearest(x, c):
    """(entry, its squared distance, that of the nearest other entry); ties to the lower entry."""
    d = squared(x, c)
    code = d.argmin(axis=1)
    here = np.arange(len(x))
    near = d[here, code]
    if len(c) == 1:
        return code, near, np.full(len(x), _FAR, d.dtype)
    d[here, code] = d.max(axis=1) + 1
    return code, near, d.min(axis=1)


class Bounds:
    """The history of one part's codebook, seen from the round it is at."""

    #: Square roots, sums and differences of a bound are off by less than this share, squared distances being below 2^63.
    SLACK = 1e-12

    def __init__(self, history: np.ndarray):
        self.now, self.round = history[-1], len(history) - 1
        d = history[-1][None].astype(np.float64) - history
        self.moved = np.sqrt((d * d).sum(axis=2)) * (1 + self.SLACK)
        k = self.moved.shape[1]
        others = np.where(np.eye(k, dtype=bool)[None], -1.0, np.repeat(self.moved[:, None, :], k, axis=1))
        #: By round and entry: how far the farthest of the other entries has gone since.
        self.others = np.maximum(others.max(axis=2), 0.0)

    def apart(self, code, near, near_at, next_, next_at):
        """Where the entry is certainly nearer than all others."""
        upper = np.sqrt(near.astype(np.float64)) * (1 + self.SLACK) + self.moved[near_at, code]
        lower = np.sqrt(next_.astype(np.float64)) * (1 - self.SLACK) - self.others[next_at, code]
        return lower > upper * (1 + self.SLACK)

    def assign(self, x, code, near, next_, near_at, next_at) -> int:
        """Brings the arrays of a part to this round, in place; returns the rows compared with all entries."""
        open_ = np.flatnonzero(~self.apart(code, near, near_at, next_, next_at))
        if len(open_):
            d = x[open_] - self.now[code[open_]]
            near[open_], near_at[open_] = (d * d).sum(axis=1), self.round
            left = ~self.apart(code[open_], near[open_], near_at[open_], next_[open_], next_at[open_])
            open_ = open_[left]
        if len(open_):
            code[open_], near[open_], next_[open_] = nearest(x[open_], self.now)
            near_at[open_] = next_at[open_] = self.round
        return len(open_)


def integers(column: pa.ListArray, width: int, wide: bool) -> np.ndarray:
    """floor(SCALE * x) of a list column, one row a vector, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    q = np.floor(flat * SCALE) if not wide else np.array([int(v) * SCALE if v.is_integer() else int(np.floor(v * SCALE)) for v in flat], object)
    q = q.reshape(n, -1) if n else q.reshape(0, width)
    out = np.zeros((n, width), object if wide else np.int64)
    out[:, : q.shape[1]] = q
    return out


def _digits(v: int) -> list[int]:
    return [(v >> 32 * k) & 0xFFFFFFFF for k in range(DIGITS - 1)] + [v >> 32 * (DIGITS - 1)]


def _lists(a: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype="<i4") if a.size else np.zeros(len(a) + 1, "<i4"), pa.array(a.reshape(-1), kind))


def _pass(rows: DataFrame, history: np.ndarray, width: int, wide: bool, last: bool) -> DataFrame:
    """One round over (row, vec, state): assigns by the last codebook of the history; adds rows of sums, with the rescans at the end."""
    step = width // PARTS
    entries = history.shape[2]
    begins = "code" not in rows.columns
    kept = [*rows.columns[:2], *_STATE]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields[:2]], T.StructField("code", T.BinaryType()), T.StructField("near", T.ArrayType(T.LongType())), T.StructField("next", T.ArrayType(T.LongType())), T.StructField("near_at", T.BinaryType()), T.StructField("next_at", T.BinaryType()), T.StructField("error", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])

    @tidy
    def run(batches):
        bounds = None if wide else [Bounds(history[:, p]) for p in range(PARTS)]
        sums, counts, rescans, kinds = np.zeros((PARTS, entries, step), object if wide else np.int64), np.zeros((PARTS, entries), np.int64), 0, None
        for b in batches:
            n, kinds = b.num_rows, (b.schema.field(0).type, b.schema.field(1).type)
            q = integers(b.column(1), width, wide)
            if begins or wide:
                code, at = np.zeros((n, PARTS), np.int64), np.zeros((2, n, PARTS), np.int64)
                near, next_ = np.zeros((n, PARTS), q.dtype), np.zeros((n, PARTS), q.dtype)
            else:
                state = lambda k: np.frombuffer(b"".join(b.column(k).to_pylist()), "u1").reshape(n, PARTS).astype(np.int64)
                code, at = state(2), np.stack([state(5), state(6)])
                near, next_ = (b.column(k).flatten().to_numpy().reshape(n, PARTS).copy() for k in (3, 4))
            for p in range(PARTS):
                x, c = q[:, p * step : (p + 1) * step], history[-1, p]
                if begins or wide:
                    code[:, p], near[:, p], next_[:, p] = nearest(x, c) if n else (0, 0, 0)
                    rescans += n
                else:
                    rescans += bounds[p].assign(x, code[:, p], near[:, p], next_[:, p], at[0, :, p], at[1, :, p])
                if last and not wide:
                    d = x - c[code[:, p]]
                    near[:, p] = (d * d).sum(axis=1)
                np.add.at(sums[p], code[:, p], x)
                counts[p] += np.bincount(code[:, p], minlength=entries)
            error = near.sum(axis=1).tolist() if last else [None] * n
            small = [e if e is None or e < 2**63 else None for e in error]
            if wide:
                near = next_ = np.zeros((n, PARTS), np.int64)
            as_bytes = lambda a: pa.array([r.tobytes() for r in a.astype("u1")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_bytes(code), _lists(near, pa.int64()), _lists(next_, pa.int64()), as_bytes(at[0]), as_bytes(at[1]), pa.array(small, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], schema.names)
        if kinds:
            flat = [d for v in sums.reshape(-1).tolist() for d in _digits(v)] if wide else sums.reshape(-1).tolist()
            flat += [*counts.reshape(-1).tolist(), rescans]
            null = lambda t: pa.nulls(1, t)
            many, raw = pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([null(kinds[0]), null(kinds[1]), null(raw), null(many), null(many), null(raw), null(raw), null(pa.int64()), pa.array([flat], many)], schema.names)

    return rows.select(*([c for c in kept if c in rows.columns])).mapInArrow(run, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = ROUNDS, report: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """(the input's columns but the vector, plus ``code`` (one byte a part) and ``error``; the final codebooks by part, entry, component).

    ``report`` gets the rows compared with all entries in each round."""
    src = vectors.drop("code", "error")
    names = [c for c in src.columns if c != vec_col]
    v = F.col(f"`{vec_col}`").cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # Columns go by number inside, so names that clash in case do no harm.
    rows = src.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), F.col(f"`{vec_col}`").alias("vec")).where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd))
    key = F.col(f"row.c{names.index(id_col)}")
    start = rows.select(key.alias("key"), "vec").orderBy(F.col("key").isNull(), "key", "vec").limit(ENTRIES).collect()
    kind = T.StructType([*[T.StructField(c, src.schema[c].dataType) for c in names], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if not start:
        return vectors.sparkSession.createDataFrame([], kind), np.zeros((PARTS, 0, 0), np.int64)
    length = len(start[0]["vec"])
    width = -(-length // PARTS) * PARTS
    rows = rows.where(F.size("vec") == length)
    start = rows.select(key.alias("key"), "vec").orderBy(F.col("key").isNull(), "key", "vec").limit(ENTRIES).collect()
    top = rows.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))))).first()[0]
    wide = 4 * (top * SCALE + 1) ** 2 * width >= 2**62
    first = integers(pa.array([list(map(float, r["vec"])) for r in start], pa.list_(pa.float64())), width, wide)
    history = first.reshape(1, len(start), PARTS, width // PARTS).transpose(0, 2, 1, 3).copy()
    spark, table = vectors.sparkSession, rows
    for at in range(rounds + 1):
        last = at == rounds
        where = shared_dir(spark)
        done = materialise(_pass(table, history, width, wide, last), where)
        if at:
            drop_folder(spark, before)
        before = where
        table = done.where("sums IS NULL")
        sums = done.where("sums IS NOT NULL").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        flat = [r["v"] for r in sums]
        if report is not None:
            report.append(flat[-1])
        if last:
            break
        entries, step = history.shape[2], width // PARTS
        n = np.array(flat[-1 - PARTS * entries : -1], object).reshape(PARTS, entries, 1)
        body = flat[: -1 - PARTS * entries]
        if wide:
            body = [sum(d << 32 * k for k, d in enumerate(body[i : i + DIGITS])) for i in range(0, len(body), DIGITS)]
        total = np.array(body, object).reshape(PARTS, entries, step)
        new = np.where(n > 0, total // np.maximum(n, 1), history[-1].astype(object))
        history = np.concatenate([history, new[None].astype(history.dtype)])
    return table.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "code", "error"), history[-1]


def codebooks_digest(codebooks: np.ndarray) -> str:
    """Hex digest of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label_col: str = "label", id_col: str = "vec_id") -> DataFrame:
    """Adds ``label_error``, the error summed over rows of the same label; rows without one are together."""
    label = F.col(f"`{label_col}`")
    keyed = coded.withColumn("__none", label.isNull()).withColumn("__label", F.coalesce(label.cast("string"), F.lit("")))
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    sums = materialise(keyed.groupBy("__none", "__label").agg(whole.alias("label_error")))
    on = ["__none", "__label"]
    joined = keyed.join(F.broadcast(sums), on) if sums.count() <= BROADCAST_LABELS else even_join(keyed, sums, on, [id_col])
    return joined.drop(*on)
