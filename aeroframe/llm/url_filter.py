"""URL filters: domain rules, then a character language-model ratio, in DataFrame functions only.

Two variable-order Markov models, of accepted and of rejected URLs, are learned
from the URLs that the rules decide. A character's probability after its
context interpolates all orders, from none to ``order``, with Witten-Bell
weights: P_k(c|ctx) = (n(ctx c) + T(ctx) P_{k-1}(c)) / (n(ctx) + T(ctx)), T being
the number of different characters seen after ctx. A URL's score is the
difference of its two log-likelihoods over its length. The threshold is set on
URLs kept out of the counts, a fifth of those decided by rules: midway between
the scores that 5 % of the accepted fall below and 5 % of the rejected lie above.

Models are counted over distinct URLs weighted by their number of rows, so a hot
host or URL is one row before anything is shuffled by its characters. The joins
run over distinct (order + 1)-grams, not over positions.

Defined results: a null url or one without ``://`` has empty host and path and
no rule; without accepted or without rejected URLs to learn from every URL that
no rule decides is allowed (there is no ratio); an empty table gives an empty
table; repeated and null ids stay as they are; a very long url is one row whose
grams are spread; columns other than id and url play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_HOT, ascii_lower, materialise

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 4
#: Characters that pad a URL's start and mark its end.
START, END = "\u0002", "\u0003"
ALPHABET = 256.0
#: Contexts of one character that are broadcast at most; Unicode has a tenth more.
BROADCAST_ROWS = 1_000_000


def after_scheme(url):
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_path(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both empty for null and for text without ://."""
    rest = F.coalesce(after_scheme(F.col(url_col)), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return df.withColumns({"host": ascii_lower(raw), "path": F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)})


def rule_verdict(rules=RULES):
    """(rule, verdict) columns over ``host`` and ``path``; the longest rule that fits wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams(text, order: int):
    """All (order + 1)-grams of the padded text, one for each character and one for its end."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def model(counts: DataFrame, order: int) -> DataFrame:
    """(gram, a, r), the weights of full grams, to one row per string of up to ``order + 1`` characters.

    n_a, n_r: its count; c_a, c_r: the count of what follows it; t_a, t_r: how
    many different characters do."""
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.substring(F.col("gram"), -k, k))
    parts = counts.select(F.explode(suffixes).alias("s"), "a", "r").groupBy("s").agg(F.sum("a").alias("n_a"), F.sum("r").alias("n_r"))
    ctx = parts.groupBy(F.expr("left(s, length(s) - 1)").alias("s")).agg(
        F.sum("n_a").alias("c_a"), F.sum("n_r").alias("c_r"), F.count_if(F.col("n_a") > 0).alias("t_a"), F.count_if(F.col("n_r") > 0).alias("t_r")
    )
    return parts.join(ctx, "s", "full_outer").na.fill(0, ["n_a", "n_r", "c_a", "c_r", "t_a", "t_r"])


def gram_scores(wanted: DataFrame, lm: DataFrame, order: int) -> DataFrame:
    """(gram) to (gram, ratio): log P_accepted - log P_rejected of its last character.

    Every gram looks up its suffixes and their contexts. Those of one character at
    most are asked for by all grams; there are no more of them than characters, and
    as many as ``BROADCAST_ROWS`` are broadcast. The others are one join."""
    look = F.expr(
        f"""concat(
          transform(sequence(0, {order}), k -> named_struct('k', k, 's', right(gram, k + 1), 'ctx', false)),
          transform(sequence(0, {order}), k -> named_struct('k', k, 's', left(right(gram, k + 1), k), 'ctx', true)))"""
    )
    rows = wanted.select("gram", F.explode(look).alias("q")).select("gram", "q.k", "q.s", "q.ctx")
    lm = materialise(lm)
    short = lm.where("length(s) <= 1")
    short = F.broadcast(short) if short.count() <= BROADCAST_ROWS else short
    hits = rows.where("length(s) <= 1").join(short, "s", "left").unionByName(rows.where("length(s) > 1").join(lm.where("length(s) > 1"), "s", "left")).na.fill(0, ["n_a", "n_r", "c_a", "c_r", "t_a", "t_r"])
    aggs = []
    for k in range(order + 1):
        for c, ctx in (("n_a", False), ("n_r", False), ("c_a", True), ("c_r", True), ("t_a", True), ("t_r", True)):
            aggs.append(F.max(F.when((F.col("k") == k) & (F.col("ctx") == ctx), F.col(c))).alias(f"{c}{k}"))
    wide = hits.groupBy("gram").agg(*aggs)

    def prob(x):
        p = F.lit(1.0 / ALPHABET)
        for k in range(order + 1):
            n, c, t = (F.col(f"{y}_{x}{k}") for y in "nct")
            p = F.when(c > 0, (n + t * p) / (c + t)).otherwise(p)
        return p

    return wide.select("gram", (F.log(prob("a")) - F.log(prob("r"))).alias("ratio"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER, held_out: int = 5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (null where a rule decides)."""
    rule, verdict = rule_verdict(rules)
    rows = host_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).withColumns({"rule": rule, "by_rule": verdict})
    text = F.coalesce(after_scheme(F.col("url")), F.col("url"), F.lit(""))
    rows = rows.withColumn("text", text)
    urls = rows.groupBy("text", "by_rule").agg(F.count(F.lit(1)).alias("n"))
    urls = materialise(urls.withColumn("fold", F.when(F.col("by_rule").isNotNull(), F.pmod(F.xxhash64("text"), F.lit(held_out)))))

    is_a, is_r = F.col("by_rule") == "allow", F.col("by_rule") == "block"
    learn = urls.where("fold > 0").select(F.explode(grams(F.col("text"), order)).alias("gram"), F.when(is_a, F.col("n")).otherwise(0).alias("a"), F.when(is_r, F.col("n")).otherwise(0).alias("r"))
    lm = model(learn.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), order)

    judged = urls.where("fold IS NULL OR fold = 0").select("text", "by_rule", "n", F.explode(grams(F.col("text"), order)).alias("gram"))
    wanted = materialise(judged.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    ratios = gram_scores(wanted.select("gram"), lm, order)
    per_url = judged.groupBy("text", "by_rule", "gram").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("times"))
    # Grams of very many urls, at most twice as many as partitions, are broadcast.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = wanted.agg(F.sum("n")).first()[0] or 0
    share = max(LEAST_HOT, total // (2 * parts))
    often = wanted.where(F.col("n") > share).select("gram")
    if total > share and not often.isEmpty():
        ratios = materialise(ratios)
        usual = per_url.join(F.broadcast(often), "gram", "left_anti").join(ratios, "gram")
        with_ratio = usual.unionByName(per_url.join(F.broadcast(ratios.join(F.broadcast(often), "gram", "left_semi")), "gram"))
    else:
        with_ratio = per_url.join(ratios, "gram")
    scored = with_ratio.groupBy("text", "by_rule").agg((F.sum(F.col("ratio") * F.col("times")) / F.sum("times")).alias("score"), F.first("n").alias("n"))
    scored = materialise(scored)
    cut = scored.agg(
        F.percentile_approx(F.when(is_a, F.col("score")), 0.05, 10000).alias("low_a"),
        F.percentile_approx(F.when(is_r, F.col("score")), 0.95, 10000).alias("high_r"),
    ).first()
    ready = cut["low_a"] is not None and cut["high_r"] is not None
    threshold = F.lit((cut["low_a"] + cut["high_r"]) / 2 if ready else None).cast("double")

    open_urls = scored.where("by_rule IS NULL").select("text", F.col("score"))
    by_method = F.when(F.col("score") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    decided = rows.where("by_rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    # Urls of very many pages, at most twice as many as partitions, are broadcast.
    undecided = rows.where("by_rule IS NULL")
    total = scored.where("by_rule IS NULL").agg(F.sum("n")).first()[0] or 0
    share = max(LEAST_HOT, total // (2 * parts))
    often = materialise(scored.where("by_rule IS NULL").where(F.col("n") > share).select("text", "score"))
    if total > share and not often.isEmpty():
        rest = undecided.join(F.broadcast(often), "text").unionByName(undecided.join(F.broadcast(often), "text", "left_anti").join(open_urls, "text", "left"))
    else:
        rest = undecided.join(open_urls, "text", "left")
    rest = rest.select("page_id", "host", "path", "rule", by_method.alias("verdict"), "score")
    return decided.unionByName(rest).withColumnRenamed("page_id", id_col)
