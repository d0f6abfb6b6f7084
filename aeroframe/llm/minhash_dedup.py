"""MinHash near-dedup: universal hash minima, banding, signature and full-set verification, components.

A document is the set of its distinct five-word shingles (64-bit hashes of
lower-cased words). ``BANDS * ROWS`` minima of universal hashes are its
signature; documents that agree on all rows of a band are candidates. At the
similarity of 0.75 a pair shares no band with probability
(1 - 0.75**5)**40 = 2e-5, and its signature's estimate falls under the least
estimate of 0.625 with probability 3e-5; both fall fast above it.

Documents with equal sets are one class, represented by its smallest id.
Inside a band's bucket no pairs are listed at first: every member is compared
with one hub, and whole groups of near copies become one component. Then only
components that share a bucket still matter. Small ones are compared member by
member, larger ones block by block inside tasks that return one link at most for
a component. So every candidate pair is verified or already connected, and no
link is lost or capped.

Defined results: null or empty text and text without words have an empty set
and link with nothing; fewer than five words are one shingle; rows without an
id are documents of their own by text, and sort after all ids below 2**62; rows
that repeat an id are one document, linked through any of them; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import even_join, materialise, own_key, slices, tidy

SHINGLE = 5
ROWS, BANDS = 5, 40
PER_CENT = 75
#: Least share of equal minima for a pair to be read in full: 0.75 less four standard errors of 200 minima.
LEAST_ESTIMATE = 0.625
#: Single documents of a bucket are compared pair by pair up to this number, beyond it by blocks of BLOCK.
FEW, BLOCK = 12, 512
#: Ids that are broadcast at most (8 MB of them); longer lists are shuffled.
BROADCAST_IDS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word to 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words: _Words, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. bytes.lower and bytes.split know ASCII only, as the contract asks."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(n, len(w))
    s = np.full(len(w) - k + 1, k, np.uint64)
    factor = _MIX[0]
    for i in range(k):
        s += _finish(w[i : len(w) - k + 1 + i]) * factor
        factor = np.uint64((int(factor) * int(_MIX[1])) % 2**64) | np.uint64(1)
    return np.unique(_finish(s))


def hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets of the universal hashes."""
    raw = np.frombuffer(b"".join(hashlib.sha256(f"universal {i}".encode()).digest()[:16] for i in range(count)), "<u8").reshape(count, 2)
    return raw[:, 0] | np.uint64(1), raw[:, 1].copy()


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The high 32 bits of the smallest value of each hash."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, count: int = ROWS * BANDS) -> DataFrame:
    """id, void (the row has none), n_shingles, cls (digest of the set) and sig (``count`` 32-bit minima); null digest and sig for an empty set."""

    @tidy
    def run(batches):
        words, (a, b) = _Words(), hash_family(count)
        for batch in slices(batches):
            n, cls, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words, shingle)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minima(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["id", "void", "n_shingles", "cls", "sig"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, "id long, void boolean, n_shingles long, cls binary, sig binary")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(F.coalesce(key, own_key(text)).alias("id"), text.alias("text"), key.isNull().alias("void"))


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is listed. A list counted as small enough is broadcast, so that texts and signatures stay where they are; a longer one is joined."""
    ids = materialise(ids.select("id").distinct())
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def similar_signatures(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """(a, b) pairs whose signatures agree on at least ``least`` of their minima."""

    @tidy
    def run(batches):
        for x in slices(batches, 1024):
            if not x.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(x.column(k).to_pylist()), "<u4").reshape(x.num_rows, -1) for k in ("sig_a", "sig_b"))
            yield x.select(["a", "b"]).filter(pa.array((sa == sb).mean(axis=1) >= least))

    sigs = materialise(only(sigs, pairs.select(F.explode(F.array("a", "b")).alias("id"))))
    both = even_join(pairs, sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), ["a"], ["b"]).join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, shingles) of the listed ids."""

    @tidy
    def run(batches):
        words = _Words()
        for batch in slices(batches):
            sets = [shingle_set(t, words, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return only(_narrow(docs, id_col, text_col), ids).mapInArrow(run, "id long, shingles binary")


def alike(p: np.ndarray, q: np.ndarray, per_cent: int) -> bool:
    """100 * intersection >= per_cent * union of two sorted sets."""
    both = len(p) + len(q)
    if 100 * min(len(p), len(q)) < per_cent * max(len(p), len(q)):
        return False
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * shared >= per_cent * (both - shared)


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The (a, b) pairs with 100 * intersection >= per_cent * union of their full sets."""

    @tidy
    def run(batches):
        for x in slices(batches):
            sets_ = (x.column(c).to_pylist() for c in ("set_a", "set_b"))
            ok = [alike(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8"), per_cent) for p, q in zip(*sets_)]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = even_join(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), ["a"], ["b"]).join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct()


def _links_of_pairs(pairs: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, shingle: int, per_cent: int) -> DataFrame:
    """Candidate (a, b) pairs to links: by signature, then by full sets."""
    likely = materialise(similar_signatures(pairs, reps, LEAST_ESTIMATE))
    need = likely.select(F.explode(F.array("a", "b")).alias("id"))
    sets = materialise(full_sets(docs, need, id_col, text_col, shingle))
    return verified(likely, sets, per_cent)


def _links_of_blocks(tied: DataFrame, crowds: DataFrame, members: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, shingle: int, per_cent: int) -> DataFrame:
    """Links that connect what may belong together, found block by block.

    tied: (big, small), components that share a bucket. crowds: (band, id), the
    single documents of a bucket that has many. members: (comp, id) of all of them.
    Blocks of both sides meet in one task, which compares signatures, then full
    sets, and returns the links of a spanning forest: nothing is listed pair by pair."""
    sets = full_sets(docs, members, id_col, text_col, shingle)
    rich = materialise(members.join(sets, "id").join(only(reps, members), "id").select("comp", "id", "sig", "shingles"))
    # Sides of the comparison: a key, the left rows' blocks and the right rows' blocks.
    left_a = tied.select(F.lit(0).alias("kind"), F.col("big").alias("key"), F.col("big").alias("comp")).distinct().join(members, "comp")
    right_a = tied.select(F.lit(0).alias("kind"), F.col("big").alias("key"), F.col("small").alias("comp")).join(members, "comp")
    crowd = crowds.select(F.lit(1).alias("kind"), F.col("band").alias("key"), F.col("id").alias("comp"), "id")
    left, right = (x.select("kind", "key", "comp", "id").unionByName(crowd) for x in (left_a, right_a))
    blocks = lambda x, n: x.groupBy("kind", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    upper = "kind = 0 OR lb <= rb"
    cols = ["kind", "key", "lb", "rb", "comp", "id", "sig", "shingles"]
    left, right = materialise(left), materialise(right)
    cells = materialise(blocks(left, "l").join(blocks(right, "r"), ["kind", "key"]))
    x = even_join(left, cells, ["kind", "key"], ["id"]).withColumn("lb", block("l")).withColumn("rb", every("r")).where(upper).join(rich, ["comp", "id"]).select(*[F.col(c).alias(c) for c in cols])
    y = even_join(right, cells, ["kind", "key"], ["id"]).withColumn("rb", block("r")).withColumn("lb", every("l")).where(upper).join(rich, ["comp", "id"]).select(*[F.col(c).alias(c) for c in cols])

    def cell(x, y):
        import pandas as pd

        out, top = [], {}

        def root(c):
            while top.get(c, c) != c:
                c = top[c]
            return c

        if len(x) and len(y):
            sx, sy = (np.frombuffer(b"".join(f["sig"]), "<u4").reshape(len(f), -1) for f in (x, y))
            px, py = ([np.frombuffer(v, "<u8") for v in f["shingles"]] for f in (x, y))
            (ix, cx), (iy, cy) = ((f["id"].tolist(), f["comp"].tolist()) for f in (x, y))
            for j in range(len(y)):
                share = (sx == sy[j]).mean(axis=1)
                for i in sorted(np.flatnonzero(share >= LEAST_ESTIMATE), key=lambda i: -share[i]):
                    if (p := root(cx[i])) != (q := root(cy[j])) and alike(px[i], py[j], per_cent):
                        out.append((ix[i], iy[j]))
                        top[p] = q
        return pd.DataFrame(out, columns=["a", "b"])

    keys = ("kind", "key", "lb", "rb")
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(cell, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, per_cent: int = PER_CENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    sigs = materialise(signatures(docs, id_col, text_col, shingle, rows * bands))
    classes = sigs.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"))
    narrow = sigs.select("id", "void", "n_shingles", "cls")
    members = materialise(even_join(narrow, classes, ["cls"], ["id"], "left").select("id", "void", "n_shingles", F.coalesce("rep", "id").alias("rep"), F.col("rep").isNotNull().alias("any")))
    # An id whose rows have different sets ties their classes together.
    torn = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("id", "a")
    torn = members.select("id", F.col("rep").alias("b")).distinct().join(torn, "id").where("a <> b").select("a", "b")

    reps = materialise(sigs.where("cls IS NOT NULL").join(classes.select("cls", F.col("rep").alias("id")), ["cls", "id"], "left_semi").dropDuplicates(["cls", "id"]).select("id", "sig"))
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(F.substring(F.col("sig"), k * (4 * rows) + 1, F.lit(4 * rows)), k))
    in_band = materialise(reps.select("id", F.explode(band).alias("band")))
    shared = in_band.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    in_band = materialise(even_join(in_band, shared, ["band"], ["id"]).select("band", "id", "lo"))

    # Every member against its bucket's hub.
    pairs = materialise(in_band.where("id > lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct())
    stars = connected_components(torn.unionByName(_links_of_pairs(pairs, docs, reps, id_col, text_col, shingle, per_cent)))

    # Components that still share a bucket.
    spread = materialise(in_band.join(stars, "id", "left").select("band", "id", F.coalesce("component", "id").alias("comp")).distinct())
    sizes = spread.select("comp", "id").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    open_bands = spread.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    spread = materialise(even_join(spread, open_bands, ["band"], ["id"], "left_semi"))
    spread = materialise(even_join(spread, sizes, ["comp"], ["id", "band"]).select("band", "id", "comp", "n"))
    # Single documents: pair by pair where a bucket has few, else by blocks.
    singles = spread.where("n = 1").select("band", "id")
    singles = materialise(even_join(singles, singles.groupBy("band").agg(F.count(F.lit(1)).alias("s")), ["band"], ["id"]).where("s > 1"))
    few = singles.where(F.col("s") <= FEW)
    few = few.select("band", F.col("id").alias("a")).join(few.select("band", F.col("id").alias("b")), "band").where("a < b").select("a", "b").distinct()
    few = _links_of_pairs(materialise(few.join(pairs, ["a", "b"], "left_anti")), docs, reps, id_col, text_col, shingle, per_cent)
    crowds = singles.where(F.col("s") > FEW).select("band", "id")
    # Larger components: each against those smaller ones that share a bucket with it.
    parts = spread.select("band", "comp", "n").distinct()
    others = parts.select("band", F.col("comp").alias("comp_b"), F.col("n").alias("n_b"))
    tied = parts.where("n > 1").join(others, "band").where((F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("comp") < F.col("comp_b"))))
    tied = materialise(tied.select(F.col("comp").alias("big"), F.col("comp_b").alias("small")).distinct())
    listed = tied.select(F.explode(F.array("big", "small")).alias("comp")).unionByName(crowds.select(F.col("id").alias("comp"))).distinct()
    listed = materialise(even_join(materialise(spread.select("comp", "id").distinct()), listed, ["comp"], ["id"], "left_semi"))
    many = _links_of_blocks(tied, crowds, listed, docs, reps, id_col, text_col, shingle, per_cent)
    star_links = stars.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b")
    comp = connected_components(star_links.unionByName(few).unionByName(many))

    out = even_join(members, comp.select(F.col("id").alias("rep"), "component"), ["rep"], ["id"], "left").withColumn("comp", F.when(F.col("any"), F.coalesce("component", "rep")).otherwise(F.col("id")))
    # A group led by a row without an id has none either.
    own = members.groupBy("id").agg(F.bool_and("void").alias("void")).where("void").select(F.col("id").alias("comp"), F.lit(True).alias("own"))
    own = materialise(own)
    if not own.isEmpty():
        out = even_join(out, own, ["comp"], ["id"], "left")
    else:
        out = out.withColumn("own", F.lit(None).cast("boolean"))
    return out.select(F.when(~F.col("void"), F.col("id")).alias(id_col), "n_shingles", F.when(F.col("own").isNull(), F.col("comp")).alias("component_id"), (F.col("id") == F.col("comp")).alias("kept"))
