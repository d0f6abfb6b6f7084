"""How far the sources of a language differ in their words: divergences by in-mapper stripes.

1. Each task folds whole documents into hash stripes: term to (document frequency, count
   by source). At a bound on what it holds it spills its stripes as rows, one a term.
2. Rows of a term meet in one task, sorted, and are merged in a stream; terms of too few
   documents go. A frequent word arrives once a spill, however often it occurs.
3. Merged stripes meet the totals of their language in slices of evenly many terms and
   directly emit divergences: sums over the slice for each pair of sources, and the best
   terms of each source. Terms that neither of two sources has all give the same value,
   so they are counted, not visited. Languages of many sources are cut into blocks of
   sources, so a task's matrices stay bounded.

All arithmetic is on integers and exact: shares are divided digit by digit in base 1000,
which holds as long as a language has fewer than 9e15 occurrences.

Defined results: null text, language and source are ''; a text without terms counts for
its group only; a document counts once for a term's frequency whatever its id, so rows that
repeat an id, or have none, are documents of their own; a very long text is folded in
windows, its distinct terms held at once; a language without kept terms gives 0 for each
pair and no terms; equal values are ordered by item; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy

SCALE = 1_000_000_000
#: A task spills when its stripes have this many cells, a cell being a term's count in one source.
CELLS = 1_500_000
#: Terms of a slice, and sources of a block.
SLICE, BLOCK = 5_000, 256
WINDOW = 1 << 20
#: A-Z to lower case, other bytes of ASCII but letters to blanks; bytes of other characters stay.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_COLUMNS = ["lang", "term", "df", "sources", "counts"]
_MERGED = "lang string, term binary, df long, sources array<string>, counts array<long>"


def terms(text: bytes):
    """A text's terms, with repeats, one list a window."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        part = text[at:end].translate(_FOLD)
        if end < len(text):  # a term that goes on is left to the next window
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):
                end += WINDOW
                part = text[at:end].translate(_FOLD)
                cut = part.rfind(b" ")
            if end < len(text):
                part = part[:cut]
        yield part.split()
        at += max(len(part), 1)


class Stripes:
    """The stripes of a language in one task, column by column: each term's document frequency, and its count in each source.

    The empty term stands in every source's column, so sources without terms are known."""

    def __init__(self):
        self.df, self.counts = Counter({b"": 0}), {}

    def add(self, text: bytes, source: str) -> int:
        """Folds a document in; returns the cells that are new."""
        column = self.counts.setdefault(source, Counter({b"": 0}))
        before, distinct = len(column), set()
        for found in terms(text):
            column.update(found)
            distinct.update(found)
        self.df.update(distinct)
        return len(column) - before

    def rows(self, lang: str, most: int = 10_000):
        """Row by row: one stripe a term."""
        place = {t: i for i, t in enumerate(self.df)}
        names = list(self.counts)
        at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in self.counts.values()])
        of = np.repeat(np.arange(len(names)), [len(c) for c in self.counts.values()])
        n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in self.counts.values()])
        order = np.argsort(at, kind="stable")
        sources = pa.DictionaryArray.from_arrays(of[order].astype("i4"), pa.array(names, pa.string())).cast(pa.string())
        counts, edges = pa.array(n[order]), np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(place)))])
        words, df = list(place), np.fromiter(self.df.values(), np.int64, len(place))
        for i in range(0, len(words), most):
            j = min(i + most, len(words))
            offsets, cells = (edges[i : j + 1] - edges[i]).astype("i4"), (edges[i], edges[j] - edges[i])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (j - i), pa.string()), pa.array(words[i:j], pa.binary()), pa.array(df[i:j]), pa.ListArray.from_arrays(offsets, sources.slice(*cells)), pa.ListArray.from_arrays(offsets, counts.slice(*cells))], _COLUMNS)


def stripes(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Spilled stripes of all documents."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang", "source"))
    src = docs.select(F.encode(text, "UTF-8").alias("text"), lang.alias("lang"), source.alias("source"))

    @tidy
    def run(batches):
        held, size = {}, 0
        for b in batches:
            texts = b.column(0)
            for k, (lang, source) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if lang not in held:
                    held[lang] = Stripes()
                size += held[lang].add(texts[k].as_py(), source)
                if size >= cells:
                    for lang, folded in held.items():
                        yield from folded.rows(lang)
                    held, size = {}, 0
        for lang, folded in held.items():
            yield from folded.rows(lang)

    return src.mapInArrow(run, _MERGED)


def merged_stripes(b: pa.RecordBatch, min_docs: int) -> pa.RecordBatch:
    """Neighbouring rows of a term as one; all but the last one only if kept."""
    n = b.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for c in b.columns[:2]:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    df = np.add.reduceat(b.column(2).to_numpy(), starts)
    keep = (df >= min_docs) | (pc.binary_length(b.column(1).take(pa.array(starts))).to_numpy() == 0)
    keep[-1] = True
    rows = b.filter(pa.array(keep[group]))
    group = np.repeat((np.cumsum(keep) - 1)[group[keep[group]]], pc.list_value_length(rows.column(3)).to_numpy())
    coded = rows.column(3).flatten().dictionary_encode()
    cell = group * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    at = np.flatnonzero(np.diff(cell, prepend=-1))
    counts = np.add.reduceat(rows.column(4).flatten().to_numpy()[order], at)
    cell = cell[at]
    offsets = np.searchsorted(cell, np.arange(keep.sum() + 1) * len(coded.dictionary)).astype("i4")
    sources = coded.dictionary.take(pa.array(cell % len(coded.dictionary)))
    first = pa.array(starts[keep])
    return pa.RecordBatch.from_arrays([b.column(0).take(first), b.column(1).take(first), pa.array(df[keep]), pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(counts))], _COLUMNS)


def merge(spilled: DataFrame, min_docs: int) -> DataFrame:
    """One stripe a term of at least ``min_docs`` documents, and the empty term of each language."""

    @tidy
    def run(batches):
        last = None
        for b in batches:
            if b.num_rows:
                b = pa.RecordBatch.from_arrays(b.columns, _COLUMNS)
                found = merged_stripes(pa.concat_batches([last, b]) if last else b, min_docs)
                yield found.slice(0, found.num_rows - 1)
                last = found.slice(found.num_rows - 1)
        if last and (last.column(2)[0].as_py() >= min_docs or not last.column(1)[0].as_py()):
            yield last

    return spilled.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, _MERGED)


def share(count: np.ndarray, total) -> np.ndarray:
    """floor(SCALE * count / total) for 0 <= count <= total < 9e15, in 64 bits."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out


def spread(p, q):
    """The value of two shares: floor((p - q)^2 / (p + q))."""
    return (p - q) * (p - q) // (p + q)


def slice_values(lang: str, first: int, names: list[str], sums: list[int], kept: int, stripes_: pa.Table, ranks: int, block: int) -> list[tuple]:
    """What a slice of a language's kept terms gives for the sources ``first .. first + block``.

    Rows (lang, source, part, item, value, either, apart, kept): of a pair the sum over terms
    that either source has, how many those are, and the value of a term that neither has."""
    s, own = len(names), range(first, min(first + block, len(names)))
    rank = {name: i for i, name in enumerate(names)}
    total = np.array(sums, np.int64)
    if kept == 0:
        return [(lang, names[i], "pair", names[j], 0, 0, 0, 0) for i in own for j in range(i + 1, s)]
    d, d_lang = total + 2 * kept, int(total.sum()) + 2 * kept
    p0 = 1 + share(np.full(s, 2), d)
    apart = spread(p0[first : first + block, None], p0[None, :])
    value, either = np.zeros((len(own), s), np.int64), np.zeros((len(own), s), np.int64)
    best: list[list] = [[] for _ in own]
    words = stripes_.column("term").to_pylist()
    rows_of, counts_of = stripes_.column("sources").to_pylist(), stripes_.column("counts").to_pylist()
    step = max(1, 1_000_000 // s)
    for at in range(0, len(words), step):
        here = words[at : at + step]
        c = np.zeros((len(here), s), np.int64)
        for k, (who, n) in enumerate(zip(rows_of[at : at + step], counts_of[at : at + step])):
            c[k, [rank[x] for x in who]] = n
        p, q = 1 + share(c + 2, d), 1 + share(c.sum(axis=1) + 2, d_lang)
        has = c > 0
        for i in own:
            mine = np.flatnonzero(has[:, i])
            f = spread(p[mine], p[mine, i][:, None])
            value[i - first] += f.sum(axis=0)
            either[i - first] += len(mine)
            up = mine[p[mine, i] > q[mine]]
            if len(up):
                best[i - first] = sorted([*best[i - first], *((-int(x), here[k]) for k, x in zip(up.tolist(), spread(p[up, i], q[up])))])[:ranks]
        # Terms that only the other source has.
        for j in range(s):
            theirs = np.flatnonzero(has[:, j])
            lack = ~has[theirs, first : first + block]
            f = spread(p[theirs, first : first + block], p[theirs, j][:, None])
            value[:, j] += np.where(lack, f, 0).sum(axis=0)
            either[:, j] += lack.sum(axis=0)
    out = [(lang, names[i], "pair", names[j], int(value[i - first, j]), int(either[i - first, j]), int(apart[i - first, j]), kept) for i in own for j in range(i + 1, s)]
    return out + [(lang, names[i], "term", t.decode("utf-8", "replace"), -x, 0, 0, kept) for i in own for x, t in best[i - first]]


def divergences(docs: DataFrame, min_docs: int = 10, ranks: int = 10, cells: int = CELLS, slice_terms: int = SLICE, block: int = BLOCK) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` compares a source with each other one of its language, part ``term`` lists what it has more of than the language."""
    merged = materialise(merge(stripes(docs, cells), min_docs))
    kept = merged.where(F.length("term") > 0)
    entry = F.explode(F.arrays_zip("sources", "counts")).alias("e")
    sums = merged.select("lang", entry).groupBy("lang", "e.sources").agg(F.sum("e.counts").alias("n"))
    totals = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("sources", "n"))).alias("s"))
    totals = totals.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left")
    totals = materialise(totals.select("lang", F.col("s.sources").alias("names"), F.col("s.n").alias("sums"), F.coalesce("kept", F.lit(0).cast("long")).alias("kept")))
    most = totals.agg(F.max("kept").alias("kept"), F.max(F.size("names")).alias("sources")).first()
    slices = max(1, -(-(most["kept"] or 0) // slice_terms))
    blocks = max(1, -(-(most["sources"] or 0) // block))
    of_term = F.pmod(F.xxhash64("term"), F.lit(slices))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    terms_ = kept.select("lang", of_term.alias("slice"), every(blocks).alias("block"), "term", "sources", "counts").groupBy("lang", "slice", "block")
    told = totals.select("*", every(slices).alias("slice")).select("*", every(blocks).alias("block")).groupBy("lang", "slice", "block")

    def values(key, left, right):
        names, sums, n = (right.column(c)[0].as_py() for c in ("names", "sums", "kept"))
        rows = slice_values(key[0].as_py(), key[2].as_py() * block, names, sums, n, left, ranks, block)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], out)

    out = ["lang", "source", "part", "item", "value", "either", "apart", "kept"]
    kinds = [pa.string()] * 4 + [pa.int64()] * 4
    found = materialise(terms_.cogroup(told).applyInArrow(values, ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in zip(out, kinds))))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("either").alias("either"), F.max("apart").alias("apart"), F.max("kept").alias("kept"))
    value = (F.col("value") + (F.col("kept") - F.col("either")) * F.col("apart")).alias("value")
    both = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b")))).alias("p")
    pairs = pairs.select("lang", value, both).select("lang", F.col("p.a").alias("source"), F.lit("pair").alias("part"), F.col("p.b").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    best = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", rank).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", rank).unionByName(best)
