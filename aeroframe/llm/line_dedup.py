"""Line dedup by levelled sorted runs of line hashes.

The store is a log-structured set of 128-bit line-key hashes with the smallest
document that holds each key. A run is a Parquet table bucketed and sorted by
hash, so a batch is shuffled once and merge-joined against every run without
moving the runs. Keys the runs lack form the batch's own run at level 0; when a
level holds ``fan_in`` runs they are merged into one run of the next level.
Batches arrive in ascending document order, so the run that knows a key names
its smallest document.

A key of many documents (a licence line of a third of them) is counted before
the rows that hold it are looked up; such keys, at most twice as many as
partitions, are broadcast, so their rows stay where they are.

Defined results: a null or empty text is one empty line; a null id sorts after
every other id, and rows without one are documents of their own by text; rows
that repeat an id are one document, whatever their texts, and none of them loses
a line to another; a very long text is one row, split line by line in its task;
an empty table gives an empty table; input columns named ``n_lines`` or
``n_dropped``, in any case, are replaced, every other column is kept.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST_HOT, WS_BYTES, materialise, own_key, save_table, shared_dir, slices, tidy

MIN_CODE_POINTS = 10


def document_key(id_col: str, text_col: str):
    """The id, or a key of its own behind all ids for a row without one."""
    return F.coalesce(F.col(id_col).cast("long"), own_key(F.col(text_col).cast("string")))


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(WS_BYTES).lower()


def key_hash(line: bytes, min_code_points: int) -> bytes | None:
    """128-bit hash of the line's key; None where the key is too short to count."""
    key = line_key(line)
    if len(key) < min_code_points or (len(key) < 4 * min_code_points and len(key.decode("utf-8", "replace")) < min_code_points):
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_code_points: int) -> DataFrame:
    """One row per document and distinct key: id, h1, h2 (the halves of the hash)."""

    @tidy
    def run(batches):
        for b in slices(batches):
            ids, h1, h2 = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {h for line in (text or "").encode("utf-8", "replace").split(b"\n") if (h := key_hash(line, min_code_points))}
                for h in found:
                    ids.append(i)
                    h1.append(int.from_bytes(h[:8], "little", signed=True))
                    h2.append(int.from_bytes(h[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["id", "h1", "h2"])

    narrow = docs.select(document_key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, h1 long, h2 long")


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder.

    ``add`` takes one batch of (id, h1, h2), whose ids follow those of earlier
    batches, and returns the (id, h1, h2) rows whose lines are to go."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = 2):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.dir = shared_dir(spark)
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write_run(self, df: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.made}"
        self.made += 1
        out = df.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2")
        save_table(out.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2"), name, f"{self.dir}/{name}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def compact(self) -> None:
        """Merge every full level into one run of the next. Keys are unique over all runs, so merging is a sorted union."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_in:
                merged, old = None, self.levels[level]
                for name in old:
                    merged = self.spark.table(name) if merged is None else merged.unionByName(self.spark.table(name))
                self.levels[level] = []
                self._write_run(merged, level + 1)
                for name in old:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            level += 1

    def add(self, batch: DataFrame) -> DataFrame:
        keys = batch.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))
        known = keys
        owners = []
        for k, name in enumerate(self.runs()):
            run = self.spark.table(name).select("h1", "h2", F.col("owner").alias(f"owner_{k}"))
            known = known.join(run.hint("merge"), ["h1", "h2"], "left")
            owners.append(F.col(f"owner_{k}"))
        known = known.select("h1", "h2", "first_id", "last_id", "n", F.coalesce(*owners, F.lit(None).cast("long")).alias("run_owner"))
        known = materialise(known, f"{self.dir}/known_{self.made}")
        self._write_run(known.where("run_owner IS NULL").withColumnRenamed("first_id", "owner"), 0)
        self.compact()
        repeated = known.where("run_owner IS NOT NULL OR first_id < last_id").select("h1", "h2", "n", F.coalesce("run_owner", "first_id").alias("keep_id"))
        rows = batch.count()
        share = max(LEAST_HOT, rows // (2 * self.buckets))
        rest, found = batch, None
        if rows > share and not (often := repeated.where(F.col("n") > share).drop("n")).isEmpty():
            found = batch.join(F.broadcast(often), ["h1", "h2"])
            rest = batch.join(F.broadcast(often), ["h1", "h2"], "left_anti")
        seldom = rest.join(repeated.where(F.col("n") <= share).drop("n"), ["h1", "h2"])
        return (seldom if found is None else seldom.unionByName(found)).where("id <> keep_id").select("id", "h1", "h2")

    def close(self) -> None:
        """Takes the runs out of the catalog."""
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_code_points: int = MIN_CODE_POINTS, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """Drop every line whose key some document of smaller id holds.

    Returns the input's columns with ``text_col`` rewritten, plus ``n_lines``
    (before dropping) and ``n_dropped``. ``batches``: into how many runs of ids
    the table is fed to the store."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL")
    cuts = sorted({int(x) for x in ids.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []})
    part = F.lit(0)
    for x in cuts:
        part = part + (F.col("id") > F.lit(x)).cast("int")
    staged = shared_dir(spark)
    line_hashes(docs, id_col, text_col, min_code_points).withColumn("part", part).write.partitionBy("part").parquet(staged)
    rows = spark.read.schema("id long, h1 long, h2 long, part int").parquet(staged)
    store, gone = LineRuns(spark, fan_in=fan_in), None
    for k in range(len(cuts) + 1):
        out = store.add(rows.where(F.col("part") == k).select("id", "h1", "h2"))
        gone = out if gone is None else gone.unionByName(out)
    store.close()
    per_doc = gone.groupBy(F.col("id").alias("__ln_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("__ln_gone"))
    return drop_lines(docs, per_doc, id_col, text_col, min_code_points)


def drop_lines(docs: DataFrame, per_doc: DataFrame, id_col: str, text_col: str, min_code_points: int) -> DataFrame:
    """Rewrite texts without the lines whose hashes ``per_doc`` lists for their id."""
    docs = docs.drop("n_lines", "n_dropped")
    kept = docs.columns
    src = docs.withColumn("__ln_id", document_key(id_col, text_col)).join(per_doc, "__ln_id", "left").drop("__ln_id")
    at = [c.lower() for c in kept].index(text_col.lower())

    @tidy
    def run(batches):
        for b in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(b.column(at).to_pylist(), b.column(len(kept)).to_pylist()):
                lines = (text or "").encode("utf-8", "replace").split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    bad = {x["h1"].to_bytes(8, "little", signed=True) + x["h2"].to_bytes(8, "little", signed=True) for x in gone}
                    lines = [x for x in lines if key_hash(x, min_code_points) not in bad]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(b"\n".join(lines).decode("utf-8"))
            cols = [b.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*kept, "n_lines", "n_dropped"])

    schema = docs.select(*[F.col(c).cast("string").alias(c) if c.lower() == text_col.lower() else F.col(c) for c in kept]).schema
    return src.mapInArrow(run, schema.add("n_lines", "long").add("n_dropped", "long"))
