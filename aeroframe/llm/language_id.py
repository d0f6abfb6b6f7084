"""Language identification by nearest centroid.

A text's vector holds its letters' 1-, 2- and 3-grams, hashed to ``dims``
buckets, square-root counts times the inverse document frequency, unit length.
Document frequencies are counted over all training documents. Each language has
several centroids: spherical k-means over a sample of its training documents of
``per_language`` expected rows. The language of the closest centroid by cosine
is the prediction; a text that lies farther from every centroid than the
``rejection`` share of what training documents of that language do is rejected.
Short texts lie farther away, so what is far enough is learned by length too, from
excerpts of a few words of the sampled documents.

The model (buckets' frequencies, a few centroids a language) has a size set by
``dims``, ``clusters`` and the number of languages, none of which grows with the
rows; only that much reaches the driver and goes out to the tasks.

Defined results: null text and text without letters are ``und`` with score 0 and
rejected; the score is the cosine, from 0 to 1; without training rows everything
is ``und``; an empty table gives an empty table; input columns named like an
output, in any case, are replaced, all others are kept. A null id counts as the
empty string when folds are dealt. Rows are sampled by id and text, so rows that
repeat an id are drawn one by one, and rows that repeat both are fitted on once.
A very long text is one row whose grams are counted in its task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, tidy

DIMS = 4096
PER_LANGUAGE = 1200
CLUSTERS = 4
ITERATIONS = 8
#: A text is rejected below this share of the cosine that all but 1 in 500 sampled documents of its language reach.
REJECTION = 0.5
UND = "und"
#: Words of the excerpts that show how far short texts lie.
EXCERPTS = (1, 2, 4, 8, 16)
_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def gram_counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts by bucket of the text's letter n-grams; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _alpha()[codes] if len(codes) else np.zeros(0, bool)
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = letter | np.concatenate([[True], letter[:-1]])
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    shift = np.uint64(64 - dims.bit_length() + 1)
    h1 = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h2 = (h1[:-1] ^ (h1[1:] >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
    h3 = (h2[:-1] ^ (h1[2:] >> np.uint64(11))) * np.uint64(0x94D049BB133111EB)
    return np.bincount(np.concatenate([h >> shift for h in (h1, h2, h3)]).astype(np.int64), minlength=dims)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.sqrt(counts) * idf).astype(np.float32)
    n = np.linalg.norm(v)
    return v / n if n else v


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: dict[str, tuple[np.ndarray, np.ndarray]]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = gram_counts(text, len(self.idf))
        if counts is None or not self.languages:
            return UND, 0.0, True
        cos = self.centroids @ vector(counts, self.idf)
        at = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[at])))
        lengths, least = self.least[self.languages[at]]
        return self.languages[at], score, score < float(np.interp(np.log(counts.sum()), lengths, least))


def _cluster(vectors: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < min(k, len(vectors)):
        # Far from the seeds so far, but no outlier: the tenth percentile, not the minimum.
        seeds.append(int(np.argsort(near, kind="stable")[len(near) // 10]))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    cents = vectors[seeds]
    for _ in range(iterations):
        label = np.argmax(vectors @ cents.T, axis=1)
        sums = np.stack([vectors[label == j].sum(axis=0) if (label == j).any() else cents[j] for j in range(len(cents))])
        cents = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return cents


def fold(id_col: str):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(4))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", dims: int = DIMS, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, iterations: int = ITERATIONS, rejection: float = REJECTION) -> Model:
    """Learn from ``train``. ``per_language`` bounds, in expectation, the rows a language's clusters are fitted on."""
    rows = train.select(F.xxhash64(F.col(order_col).cast("string"), F.col(text_col).cast("string"), F.lit("fit")).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")

    @tidy
    def frequencies(batches):
        df, langs = np.zeros(dims, np.int64), {}
        for b in slices(batches):
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                counts = gram_counts(text, dims)
                if counts is not None:
                    df += counts > 0
                    langs[lang] = langs.get(lang, 0) + 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at) + list(langs), pa.string()), pa.array([*at.tolist(), *[-1] * len(langs)], pa.int64()), pa.array([*df[at].tolist(), *langs.values()], pa.int64())], ["lang", "bucket", "n"])

    seen = rows.mapInArrow(frequencies, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = {r["lang"]: r["n"] for r in seen if r["bucket"] < 0}
    df = np.zeros(dims)
    for r in seen:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    if not counts:
        return Model([], np.zeros((0, dims), np.float32), idf, {})

    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    sample = rows.where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * F.lit(float(1 << 40))).dropDuplicates(["lang", "h"])

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "text"], kind="stable")
        found = [c for t in group["text"] if (c := gram_counts(t, dims)) is not None]
        if not found:
            return pd.DataFrame({"lang": [], "lengths": [], "least": [], "centroid": []})
        vectors = np.stack([vector(c, idf) for c in found])
        cents = _cluster(vectors, clusters, iterations)
        lengths, least = [], []
        for words in (*EXCERPTS, None):
            parts = [c for t, h in zip(group["text"], group["h"]) if (c := gram_counts(_excerpt(t, words, h), dims)) is not None] if words else found
            if not parts:  # no excerpt of this length holds a letter
                continue
            cos = np.array([(cents @ vector(c, idf)).max() for c in parts])
            lengths.append(float(np.log(np.median([c.sum() for c in parts]))))
            least.append(float(np.quantile(cos, 0.002)) * rejection)
        # A longer text is never allowed to lie farther than a shorter one.
        order = np.argsort(lengths, kind="stable")
        lengths, least = np.array(lengths)[order], np.maximum.accumulate(np.array(least)[order])
        return pd.DataFrame({"lang": group["lang"].iloc[0], "lengths": [lengths.tolist()] * len(cents), "least": [least.tolist()] * len(cents), "centroid": [c.astype(float).tolist() for c in cents]})

    got = sample.groupBy("lang").applyInPandas(centroids, "lang string, lengths array<double>, least array<double>, centroid array<double>").collect()
    got.sort(key=lambda r: (r["lang"], r["centroid"]))
    return Model([r["lang"] for r in got], np.array([r["centroid"] for r in got], np.float32).reshape(len(got), dims), idf, {r["lang"]: (np.array(r["lengths"]), np.array(r["least"])) for r in got})


def _excerpt(text: str, words: int, h: int) -> str:
    """So many neighbouring words from a place that the row's hash chooses."""
    found = text.split()
    at = h % max(1, len(found) - words + 1)
    return " ".join(found[at : at + words])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's columns plus lang_pred, score and rejected."""
    src = docs.drop("lang_pred", "score", "rejected")
    at = [c.lower() for c in src.columns].index(text_col.lower())
    src = src.withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    @tidy
    def run(batches):
        for b in slices(batches):
            out = [model.predict(t) for t in b.column(at).to_pylist()]
            cols = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], schema.names)

    return src.mapInArrow(run, schema)


def fit_on_documents(docs: DataFrame, **options) -> Model:
    """Learn from the labelled documents whose fold is not 2."""
    return fit(docs.where(fold("doc_id") != 2), **options)
