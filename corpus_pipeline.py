"""A training-corpus pipeline: each stage applies one operator to all rows its predecessor kept.

Language ID drops what it rejects, line dedup rewrites texts, near-dedup keeps
one document of each group, mixing repeats or drops documents to its sources'
targets, and BPE encodes what is left. Every stage but the last returns the
columns of ``documents``.

Defined results: null, empty and letterless texts are rejected by the first stage;
rows without an id, and rows that repeat an id with another text, are documents of
their own in near-dedup and are never merged by their id; rows that repeat id and
text are one document, of which the first in the order of the other columns stays;
a very long text goes through whole; columns beyond those of ``documents`` are kept
up to the last stage, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aeroframe.llm import bpe, language_id, line_dedup, minhash_dedup, mixing
from aeroframe.llm.common import even_join, materialise, own_key, scratch, shared_dir


def language_stage(spark, docs, sf_dir):
    model = language_id.fit_on_documents(docs)
    return language_id.identify(docs, model).where("NOT rejected").select(*docs.columns)


def line_stage(spark, docs, sf_dir):
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark, docs, sf_dir):
    """Rows of one id and different texts are documents of their own, the first text under its id; so are rows without an id."""
    digest, own = F.md5(F.encode("text", "UTF-8")), own_key("doc_id", "text")
    torn = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce(digest, F.lit(""))).alias("__first"), F.max(F.coalesce(digest, F.lit(""))).alias("__last"))
    torn = materialise(torn.where("__first <> __last").select("doc_id", "__first"))
    n = torn.count()
    if n:
        keyed = docs.join(F.broadcast(torn), "doc_id", "left") if n <= minhash_dedup.BROADCAST_IDS else even_join(docs, torn, ["doc_id"], ["text"], "left")
    else:
        keyed = docs.withColumn("__first", F.lit(None).cast("string"))
    first = F.col("__first").isNull() | (F.col("__first") == F.coalesce(digest, F.lit("")))
    keyed = keyed.withColumn("__key", F.coalesce(F.when(first, F.col("doc_id").cast("long")), own)).drop("__first")
    stay = minhash_dedup.near_duplicates(keyed, "__key").where("kept").select("__key").distinct()
    # Rows of one key and text differ in other columns at most: the first in their order stays.
    rank = F.row_number().over(Window.partitionBy("__key", digest).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    return keyed.join(stay, "__key", "left_semi").withColumn("__rank", rank).where("__rank = 1").select(*docs.columns)


def mixing_stage(spark, docs, sf_dir):
    return mixing.apply_mix(docs, mixing.mix(docs))


def bpe_stage(spark, docs, sf_dir):
    return bpe.round_trip(docs.select("doc_id", "source", "text"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Learned centroids, random rounding and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; what a stage wrote on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = shared_dir(spark)
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), kept)
    return STAGES[-1][1](spark, docs, sf_dir)
