"""Approximate nearest neighbours by multi-index hashing.

Vectors are turned into binary codes: a rotation learned on a bounded sample by
alternating between the codes and the rotation that fits them best (iterative
quantisation), more rotations where ``bits`` exceeds the dimensions. For the
largest inner product, vectors get one more component that brings all to the
same length, so that angle and product order alike.

A code is cut into 16-bit substrings, each indexed. By the pigeonhole, a code
within Hamming radius r of the query's agrees with it on some substring k to
within reach_k bits, where the sum of (reach_k + 1) is r + 1. So a query probes,
in every index, the keys that differ from its own in at most reach_k bits, and
what those keys list holds every code within r; nothing else is looked at. The
listed codes' full distance is checked, and those within r are ranked by the
exact product of the original vectors. The radius is the ``quantile`` of the
code distances between a sample of queries and their true neighbours among all
rows. A query that finds fewer than k searches again with a wider radius.

The search has two rounds. The first has the radius within which half the sampled
queries have 2 k codes; the k-th best product found there bounds the query's k-th
nearest from below. The second has the whole radius, and of what it retrieves only
products of the bound or more leave a task: a few times k a query, however many
cells it probes.

Each index is dealt into at most ``cell`` rows a cell, fewer where there would be
less than a cell for every partition: ranges of its keys, and for a key with more
rows than that, parts of it by a hash of the id. A directory of 2**16 entries a
substring, whatever the size of the table, tells a query the cells its probed keys
lie in. A row goes to one cell of each index, a query to the cells it probes; a
task holds one cell's index and lets the queries stream past it. No cell depends on
how rows cluster, so repeated or close vectors make no task larger than others.

Defined results: vectors that are null, empty, zero, of another length than most
or that hold null or non-finite components take no part, nor do null ids; rows
that repeat an id and its vector count once, rows that repeat an id with another
vector are candidates of their own; ties go to the smaller id; fewer than k
candidates are all returned; columns other than id and vector play no part,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, tidy

BITS = 64
SUB = 16
KEYS = 1 << SUB
SAMPLE = 4096
SAMPLE_QUERIES = 256
QUANTILE = 0.95
#: Rows of an index cell: at most, and where cells are made smaller so that every partition has one, at least.
CELL, LEAST_CELL = 65_536, 2048
#: Partitions that cells are dealt to at most; a partition then holds several cells, one after the other.
MOST_PARTITIONS = 20_000


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, v of floats as they are given or of doubles."""
    given = vectors.schema[vec_col].dataType
    kind = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0))


def learn_rotations(x: np.ndarray, bits: int, rounds: int = 15) -> np.ndarray:
    """(dims, bits) matrix whose columns' signs are the code."""
    d = x.shape[1]
    rng = np.random.default_rng(11)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            code = np.where(x @ r >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(x.T @ code)
            r = u @ vt
        parts.append(r)
    return np.concatenate(parts, axis=1)[:, :bits]


def lengthened(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Unit vectors with one more component: candidates up to the longest's length; queries (None) get 0 there."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    if longest is None:
        return np.concatenate([x / norms, np.zeros_like(norms)], axis=1)
    return np.concatenate([x / longest, np.sqrt(np.maximum(0, 1 - (norms / longest) ** 2))], axis=1)


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """(n, bits / 16) substrings as uint16."""
    return np.packbits(x @ rotations >= 0, axis=1).view(np.uint16)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Code distance of p[i] and q[i]."""
    return np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int16)


def reaches(radius: int, subs: int) -> list[int]:
    """Bits to probe in each substring, -1 for none: the sum of (reach + 1) is radius + 1."""
    each, more = divmod(radius + 1, subs)
    return [min(SUB, each - 1 + (k < more)) for k in range(subs)]


def flips(reach: int) -> np.ndarray:
    """All keys of at most ``reach`` ones: a key's probes are its exclusive-or with them."""
    out = [sum(1 << b for b in at) for n in range(reach + 1) for at in combinations(range(SUB), n)]
    return np.array(out, np.uint16)


def spread(ids: np.ndarray) -> np.ndarray:
    """A hash of ids that deals a frequent key's rows to its cells."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


class Directory:
    """Which cells hold a substring's key: ``first`` (-1 where no row has it) and ``width``, both (substrings, 2**16)."""

    def __init__(self, counts: np.ndarray, cell: int):
        subs = len(counts)
        self.first, self.width = np.full((subs, KEYS), -1, np.int32), np.ones((subs, KEYS), np.int32)
        self.cells = 0
        for k in range(subs):
            n = counts[k]
            target = max(1.0, n.sum() / max(1, math.ceil(n.sum() / cell)))
            hot = n > target
            plain = np.flatnonzero((n > 0) & ~hot)
            if len(plain):
                at = ((np.cumsum(n[plain]) - n[plain] / 2) // target).astype(np.int64)
                at = np.unique(at, return_inverse=True)[1]
                self.first[k, plain] = self.cells + at
                self.cells += int(at.max()) + 1
            for key in np.flatnonzero(hot):
                self.first[k, key], self.width[k, key] = self.cells, math.ceil(n[key] / target)
                self.cells += int(self.width[k, key])

    def of_row(self, ids: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
        """The one cell of substring k's index that lists each row."""
        key = code[:, k]
        return self.first[k, key] + (spread(ids) % self.width[k, key].astype(np.uint64)).astype(np.int32)

    def of_query(self, key: int, masks: np.ndarray, k: int) -> np.ndarray:
        """The cells of substring k's index that hold a probed key."""
        probes = masks ^ key
        first = self.first[k, probes]
        there = first >= 0
        first, width = first[there], self.width[k, probes[there]]
        wide = width > 1
        parts = [first[~wide], *(np.arange(f, f + w) for f, w in zip(first[wide], width[wide]))]
        return np.unique(np.concatenate(parts)) if len(first) else first


class Cell:
    """One cell of substring k's index: its rows by key, in lists that probes look up."""

    def __init__(self, ids: np.ndarray, code: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(code[:, k], kind="stable")
        self.ids, self.code, self.vectors, self.k = ids[order], code[order], vectors[order], k
        self.count = np.bincount(self.code[:, k], minlength=KEYS).astype(np.int32)
        self.start = (np.cumsum(self.count) - self.count).astype(np.int32)

    def listed(self, code: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) positions of all that the probed keys list."""
        probes = code[:, self.k, None] ^ masks
        n = self.count[probes]
        q, m = np.nonzero(n)
        n, start = n[q, m], self.start[probes[q, m]]
        row = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(q, n), row

    def within(self, code: np.ndarray, masks: np.ndarray, reach: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) positions of the listed within the radius; a pair that an earlier substring lists too is left to that one."""
        q, row = self.listed(code, masks)
        near = distances(code[q], self.code[row]) <= radius
        q, row = q[near], row[near]
        apart = np.bitwise_count(code[q, : self.k] ^ self.code[row, : self.k])
        own = (apart > np.array(reach[: self.k])).all(axis=1)
        return q[own], row[own]

    def best(self, ids: np.ndarray, code: np.ndarray, vectors: np.ndarray, bound: np.ndarray, masks: np.ndarray, reach: list[int], radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, row id, score) of each query's k best among those within the radius that reach its bound."""
        q, row = self.within(code, masks, reach, radius)
        other = self.ids[row] != ids[q]
        q, row = q[other], row[other]
        score = np.einsum("ij,ij->i", self.vectors[row], vectors[q])
        reached = score >= bound[q]
        q, row, score = q[reached], row[reached], score[reached]
        order = np.lexsort((self.ids[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        return ids[q[top]], self.ids[row[top]], score[top]


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sampled_distances(coded: DataFrame, q: list, rotations: np.ndarray, k: int) -> tuple[list[int], np.ndarray]:
    """Of sampled queries (rows of id and v): the code distances of their k true nearest among all rows, and how many rows lie at each code distance, one line a query."""
    ids, x, bits = np.array([r["id"] for r in q]), np.array([r["v"] for r in q], float), rotations.shape[1]
    code = codes(lengthened(x, None), rotations)

    @tidy
    def run(batches):
        kept = [(np.empty(0), np.empty(0, np.int16))] * len(ids)
        lie = np.zeros((len(ids), bits + 1), np.int64)
        for b in slices(batches, 2048):
            score = x @ matrix(b.column(1)).astype(float).T
            there, own = matrix(b.column(2)).astype(np.uint16), b.column(0).to_numpy()
            score[ids[:, None] == own] = -np.inf
            for i in range(len(ids)):
                far = distances(there, code[i])
                lie[i] += np.bincount(far, minlength=bits + 1)
                top = np.argpartition(-score[i], k - 1)[:k] if score.shape[1] > k else np.arange(score.shape[1])
                s, d = np.concatenate([kept[i][0], score[i, top]]), np.concatenate([kept[i][1], far[top]])
                top = np.argsort(-s, kind="stable")[:k]
                kept[i] = s[top], d[top]
        for i, (s, d) in enumerate(kept):
            fine = np.isfinite(s)
            at = np.flatnonzero(lie[i])
            nulls = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(fine.sum(), i)), pa.array(s[fine]), pa.array(d[fine].astype(np.int32)), nulls(int(fine.sum()), pa.int64())], ["q", "score", "far", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), nulls(len(at), pa.float64()), pa.array(at.astype(np.int32)), pa.array(lie[i, at])], ["q", "score", "far", "n"])

    found = materialise(coded.select("id", "v", "code").mapInArrow(run, "q long, score double, far int, n long"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "far")
    near = found.where("n IS NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("far").collect()
    lie = np.zeros((len(ids), bits + 1), np.int64)
    for r in found.where("n IS NOT NULL").groupBy("q", "far").agg(F.sum("n").alias("n")).collect():
        lie[r["q"], r["far"]] = r["n"]
    return [r["far"] for r in near], lie


def probe(coded: DataFrame, queries: DataFrame, directory: Directory, radius: int, subs: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): in every cell a query probes, its k best within the radius that reach its ``bound``."""
    reach = reaches(radius, subs)
    used = [j for j in range(subs) if reach[j] >= 0]
    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("sub", T.IntegerType()), *queries.schema.fields])

    def routed(b, at, cells, side, sub):
        fixed = [pa.array(cells.astype(np.int64)), pa.array(np.full(len(cells), side, np.int32)), pa.array(np.full(len(cells), sub, np.int32))]
        return pa.RecordBatch.from_arrays([*fixed, *b.take(pa.array(at)).columns], schema.names)

    @tidy
    def rows(batches):
        for b in slices(batches, 2048):
            code = matrix(b.column("code")).astype(np.uint16)
            for j in used:
                yield routed(b, np.arange(b.num_rows), directory.of_row(b.column("id").to_numpy(), code, j), 0, j)

    @tidy
    def asked(batches):
        masks = {j: flips(reach[j]) for j in used}
        for b in slices(batches, 128):
            code = matrix(b.column("code")).astype(np.uint16)
            for j in used:
                cells = [directory.of_query(c, masks[j], j) for c in code[:, j]]
                yield routed(b, np.repeat(np.arange(b.num_rows), [len(c) for c in cells]), np.concatenate([*cells, np.empty(0, np.int32)]), 1, j)

    @tidy
    def search(batches):
        masks = {j: flips(reach[j]) for j in used}
        here, pending, index = None, [], None
        for b in slices(batches, 128):
            cell, side = b.column("cell").to_numpy(), b.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell * 2 + side)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                ids, code, v = part.column("id").to_numpy(), matrix(part.column("code")).astype(np.uint16), matrix(part.column("v")).astype(float)
                if cell[lo] != here:
                    here, pending, index = cell[lo], [], None
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                if side[lo] == 0:
                    pending.append((ids, code, v))
                    continue
                j = part.column("sub")[0].as_py()
                if index is None:
                    index, pending = Cell(*(np.concatenate(x) for x in zip(*pending)), j), []
                found = index.best(ids, code, v, bound, masks[j], reach, radius, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    both = coded.withColumn("bound", F.lit(0.0)).select(queries.columns).mapInArrow(rows, schema).unionByName(queries.mapInArrow(asked, schema))
    parts = max(1, min(directory.cells, MOST_PARTITIONS))
    dealt = both.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "side")
    return dealt.mapInArrow(search, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, bits: int = BITS, sample: int = SAMPLE, sample_queries: int = SAMPLE_QUERIES, quantile: float = QUANTILE, cell: int = CELL) -> DataFrame:
    """Each query row's k nearest: query_id, rank, vec_id, score.

    ``is_query``: a condition over column ``id``. ``sample``: expected rows the
    rotations are fitted on, ``sample_queries`` of which find the radius.
    ``bits``: a multiple of 16."""
    rows, subs = usable(vectors, id_col, vec_col), bits // SUB
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    if not size["n"]:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    longest = size["longest"] * (1 + 1e-9)
    share = min(1.0, sample / size["n"])
    fit = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).orderBy(F.xxhash64("id", F.lit("order")), "id").limit(2 * sample).collect() or [rows.first()]
    rotations = learn_rotations(lengthened(np.array([r["v"] for r in fit], float), longest), bits)

    def encoder(longest):
        @tidy
        def run(batches):
            for b in slices(batches, 2048):
                if b.num_rows:
                    code = codes(lengthened(matrix(b.column(1)).astype(float), longest), rotations)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * subs), pa.array(code.astype(np.int32).ravel()))
                    yield pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "v", "code"])

        return run

    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.ArrayType(T.IntegerType()))])
    coded = materialise(rows.dropDuplicates(["id", "v"]).mapInArrow(encoder(longest), schema))
    # At most 2**16 rows a substring, whatever the table's size.
    seen = coded.select(F.posexplode("code").alias("sub", "key")).groupBy("sub", "key").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros((subs, KEYS), np.int64)
    counts[seen["sub"].to_numpy(), seen["key"].to_numpy()] = seen["n"].to_numpy()
    n, parts = int(counts[0].sum()), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    directory = Directory(counts, min(cell, max(LEAST_CELL, math.ceil(n * subs / parts))))
    far, lie = sampled_distances(coded, fit[:sample_queries], rotations, k)
    radius = int(np.quantile(far, quantile, method="higher")) if far else bits
    first = min(radius, int((np.median(np.cumsum(lie, axis=1), axis=0) < 2 * k).sum()))

    queries = materialise(coded.where(is_query).select("id", "v").mapInArrow(encoder(None), schema))
    near = probe(coded, queries.withColumn("bound", F.lit(float("-inf"))), directory, first, subs, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    bounds = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), (F.col("score") - F.abs("score") * 1e-12).alias("bound"))
    todo = materialise(queries.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))))
    found, wider = None, subs
    while True:
        here = materialise(probe(coded, todo, directory, radius, subs, k))
        enough = here.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
        short = todo.join(enough, F.col("id") == F.col("query_id"), "left_anti")
        if radius >= bits or short.isEmpty():
            found = here if found is None else found.unionByName(here)
            break
        ready = here.join(enough, "query_id", "left_semi")
        found = ready if found is None else found.unionByName(ready)
        todo, radius, wider = materialise(short), min(bits, radius + wider), 2 * wider
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
