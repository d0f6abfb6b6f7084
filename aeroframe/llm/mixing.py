"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source gets the same expected number of copies, its
source's target over its source's size: a whole part and a fraction. Fractions
are rounded together. Two documents at a time, random mass (words) moves from
one to the other until one fraction is 0 or 1; what is left goes on to the next
pair. Expected copies are kept, and so are the source's words, to within the one
document that stays fractional at the end. Pairs are folded inside small random
blocks, the blocks' residuals form the next level's rows, and so on up a
reduction tree of ``fan_in``, one narrow shuffle a level.

Defined results: null text has size 0; null source is a source of its own,
after all others; rows that repeat id, source and size are rounded as one; a
document of size 0 rounds alone; a very long text only counts as many words; null
ids are rounded together where source and size agree; all draws are hashes of ids
and the seed, so reruns agree; columns other than id, text and source play no part
in ``mix``, whatever their names, and ``apply_mix`` keeps them; an empty table gives
an empty table. Targets are computed over the table of sources, in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WS, materialise

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_COPIES = 2
FAN_IN = 48


def n_words(text):
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"{NOT_WS}+")), F.lit(0)).cast("long")


def source_key(source):
    """A string that sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_copies: float = MAX_COPIES) -> DataFrame:
    """(sk, source_size, n_keys) to the same rows with ``target``.

    Water filling in closed form: by cap over weight ascending, a source is at
    its cap while the level that the rest could share lies above its own."""
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy("sk")
    rank = F.row_number().over(by_name) - 1
    w = sizes.withColumn("weight", F.element_at(cyc, (rank % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    order = Window.orderBy((F.col("cap") / F.col("weight")), "sk")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(total_share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_rest"))
        .withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
        .withColumn("shared", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(all_rows))
    )
    return w.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("shared") * F.col("weight")))).select("sk", "source_size", "n_keys", "target")


def uniform(*cols):
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


#: One pairing step. acc.cur and x are fractional; mass is words. `up` moves mass to cur.
_STEP = """
aggregate(slice(items, 2, size(items)), named_struct('cur', items[0], 'done', slice(items, 1, 0)),
  (acc, x) -> CASE
    WHEN x.u * (least((1 - acc.cur.p) * acc.cur.w, x.p * x.w) + least(acc.cur.p * acc.cur.w, (1 - x.p) * x.w))
         < least(acc.cur.p * acc.cur.w, (1 - x.p) * x.w)
    THEN CASE WHEN (1 - acc.cur.p) * acc.cur.w <= x.p * x.w
      THEN named_struct('cur', {x_less}, 'done', array_append(acc.done, {cur_one}))
      ELSE named_struct('cur', {cur_more}, 'done', array_append(acc.done, {x_zero})) END
    ELSE CASE WHEN acc.cur.p * acc.cur.w <= (1 - x.p) * x.w
      THEN named_struct('cur', {x_more}, 'done', array_append(acc.done, {cur_zero}))
      ELSE named_struct('cur', {cur_less}, 'done', array_append(acc.done, {x_one})) END
  END)
"""


def _item(of: str, p: str) -> str:
    return f"named_struct('u', {of}.u, 'key', {of}.key, 'w', {of}.w, 'p', cast({p} AS double))"


_FOLD = _STEP.format(
    cur_one=_item("acc.cur", "1"), cur_zero=_item("acc.cur", "0"), x_one=_item("x", "1"), x_zero=_item("x", "0"),
    x_less=_item("x", "greatest(0, x.p - (1 - acc.cur.p) * acc.cur.w / x.w)"), x_more=_item("x", "least(1, x.p + acc.cur.p * acc.cur.w / x.w)"),
    cur_more=_item("acc.cur", "least(1, acc.cur.p + x.p * x.w / acc.cur.w)"), cur_less=_item("acc.cur", "greatest(0, acc.cur.p - (1 - x.p) * x.w / acc.cur.w)"),
)


def pivotal_round(rows: DataFrame, max_group: int, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """(sk, key, w, p, n_keys) with 0 < p < 1 to (sk, key, p) with p 0 or 1.

    ``max_group``: rows of the largest group, which sets the number of levels."""
    done, level = None, 0
    here = rows.withColumn("blocks", F.ceil(F.col("n_keys") / fan_in).cast("long"))
    blocks = max(1, math.ceil(max_group / fan_in))
    while True:
        block = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level), F.lit("block")), F.col("blocks"))
        item = F.struct(uniform("key", F.lit(seed), F.lit(level)).alias("u"), "key", "w", "p")
        folded = here.withColumn("block", block).groupBy("sk", "block").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_list(item)).alias("items"))
        folded = folded.select("sk", "blocks", F.expr(_FOLD).alias("f"))
        out = materialise(folded.select("sk", "blocks", F.explode(F.array_append("f.done", F.col("f.cur"))).alias("i")).select("sk", "blocks", "i.key", "i.w", "i.p"))
        whole = out.where("p = 0 OR p = 1").select("sk", "key", "p")
        done = whole if done is None else done.unionByName(whole)
        rest = out.where("p > 0 AND p < 1")
        if blocks == 1:
            last = rest.select("sk", "key", F.when(uniform("key", F.lit(seed), F.lit("last")) < F.col("p"), 1.0).otherwise(0.0).alias("p"))
            return done.unionByName(last)
        here = rest.withColumn("blocks", F.ceil(F.col("blocks") / fan_in).cast("long"))
        blocks, level = math.ceil(blocks / fan_in), level + 1


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_copies: int = MAX_COPIES, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Copies of each document: (id, sk, size, n_rows, source_size, target, copies), one row per id, source and size."""
    narrow = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("sk"), n_words(F.col(text_col)).alias("size"))
    keys = materialise(narrow.groupBy("id", "sk", "size").agg(F.count(F.lit(1)).alias("n_rows")))
    per_source = keys.groupBy("sk").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_keys"))
    goal = materialise(targets(per_source, weights, total_share, max_copies))
    largest = goal.agg(F.max("n_keys")).first()[0] or 1
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = keys.join(goal, "sk").withColumn("each", each).withColumn("base", F.floor("each")).withColumn("frac", F.col("each") - F.col("base"))
    rows = rows.withColumn("key", F.struct("id", "size", "n_rows", "source_size", "target", "base"))
    drawn = pivotal_round(rows.where("frac > 0 AND size > 0").select("sk", "key", (F.col("size") * F.col("n_rows")).cast("double").alias("w"), F.col("frac").alias("p"), "n_keys"), largest, seed, fan_in)
    alone = rows.where("NOT (frac > 0 AND size > 0)").select("sk", "key", F.when(uniform("key", F.lit(seed), F.lit("alone")) < F.col("frac"), 1.0).otherwise(0.0).alias("p"))
    return drawn.unionByName(alone).select("key.id", "sk", "key.size", "key.n_rows", "key.source_size", "key.target", (F.col("key.base") + F.col("p")).cast("long").alias("copies"))


def apply_mix(docs: DataFrame, copies: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the input's columns."""
    have = docs.withColumn("__mx_sk", source_key(F.col(source_col))).withColumn("__mx_size", n_words(F.col(text_col)))
    take = copies.where("copies > 0").select(F.col("id").alias("__mx_id"), F.col("sk").alias("__mx_k"), F.col("size").alias("__mx_n"), F.col("copies").alias("__mx_copies"))
    on = have[id_col].eqNullSafe(take["__mx_id"]) & (have["__mx_sk"] == take["__mx_k"]) & (have["__mx_size"] == take["__mx_n"])
    out = have.join(take, on).withColumn("__mx_rep", F.explode(F.sequence(F.lit(1), F.col("__mx_copies").cast("int"))))
    return out.select(*[have[c] for c in docs.columns])
