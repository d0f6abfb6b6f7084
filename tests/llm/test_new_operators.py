"""Divergence of sources, vector codes and token counts against brute force, with the rows that every operator must take."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from aeroframe.llm import divergence, queries, token_counts, vector_codes

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# divergence of sources


def brute_divergences(rows, min_docs=10, ranks=10):
    """Rows of (text, lang, source), by dictionaries and Python's integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        counts[lang, source].update(found)
        df[lang].update(found.keys())
    out = []
    for lang in {r[1] for r in rows}:
        kept = {t for t, n in df[lang].items() if n >= min_docs}
        sources = sorted({s for g, s in counts if g == lang})
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}  # noqa: B023

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            best = [(-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", best, ranks)):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def told(spark, rows, **bounds):
    df = spark.createDataFrame([(i, *r, 1.0, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, TERM double, Counts string")
    return sorted(tuple(r) for r in divergence.divergences(df, **bounds).collect())


def invented(n, seed, words=60, sources=("a", "b", "c", None, "é", "Z")):
    rng = random.Random(seed)
    word = lambda: rng.choice(["wo", "Ça", "the", "x", "漢"]) + chr(97 + rng.randrange(words) % 26) * (1 + rng.randrange(words) // 26)
    return [(rng.choice([" ", "-", "\n", "\x00", "9", "_", "\x7f"]).join(word() for _ in range(rng.randrange(0, 40))) if rng.random() < 0.95 else None, rng.choice(["en", "de", None]), rng.choice(sources)) for _ in range(n)]


@pytest.mark.parametrize("bounds", [{}, {"cells": 50, "slice_terms": 7, "block": 2}])
def test_divergences(spark, bounds):
    rows = invented(250, 3) + [("", "en", "no words"), ("only here " * 3, "fr", "one"), ("1 2 3", "fr", "none"), ("same words", "xx", "s")] + [("same words", "xx", "t")] * 12
    got, want = told(spark, rows, **bounds), brute_divergences(rows)
    assert got == want and {r[2] for r in got} == {"pair", "term"}
    assert sorted(r[3:5] for r in got if r[0] == "fr") == [("none", 0), ("one", 0)]
    assert ("xx", "t", "term", "same", 0, 1) not in got


def test_divergences_of_few_documents(spark):
    rows = invented(40, 5)
    assert told(spark, rows, min_docs=1) == brute_divergences(rows, 1)
    assert told(spark, rows[:1]) == [] and told(spark, []) == []


def test_divergences_of_long_and_hot_texts(spark, monkeypatch):
    rows = [("hot " * 5 + "word", "en", "a")] * 3000 + invented(60, 8) + [("x" * 5000 + " " + "long " * 30_000, "en", "b")]
    monkeypatch.setattr(divergence, "WINDOW", 97)
    assert Counter(t for w in divergence.terms(rows[-1][0].encode()) for t in w) == Counter({b"x" * 5000: 1, b"long": 30_000})
    monkeypatch.undo()
    assert told(spark, rows) == brute_divergences(rows)


def test_shares_are_exact():
    rng = random.Random(4)
    for _ in range(2000):
        total = rng.randrange(1, 9 * 10 ** rng.randrange(1, 16))
        count = rng.randrange(total + 1)
        assert int(divergence.share(np.array([count]), total)[0]) == 1_000_000_000 * count // total


# vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """{id: (code, error)} and the codebooks; rows of (id, vector), full comparisons in Python's integers."""
    rows = sorted((i, [int(x * 4096 // 1) for x in v]) for i, v in rows)
    step = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v in rows[:entries]] for p in range(parts)]

    def codes():
        def best(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

        return [[best(cut(v, p), books[p]) for p in range(parts)] for _, v in rows]

    for _ in range(rounds):
        found = codes()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, v), f in zip(rows, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    return {i: (bytes(k for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(rows, codes())}, [x for b in books for c in b for x in c]


def coded(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, CODE string, Vec int") if rows else spark.createDataFrame([], f"vec_id long, embedding array<{kind}>, label int, CODE string, Vec int")
    return vector_codes.compress(df, **more)


def clustered(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(9, width)) * scale
    return (at[rng.integers(0, 9, n)] + 0.2 * scale * rng.normal(size=(n, width))).astype("f4").tolist()


def test_codes_of_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()]
    want, books = brute_codes(rows)
    got = queries()["op12_vector_codes"](spark, DATA).collect()
    assert {r.vec_id: (bytes.fromhex(r.code), r.error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {vector_codes.codebooks_digest(np.array(books))}


def test_bounds_save_work_and_change_nothing(spark):
    vectors = clustered(800, 32, 1)
    rows = [(i, v, None, None, None) for i, v in enumerate(vectors)]
    report = []
    out, books = coded(spark, rows, report=report)
    want, flat = brute_codes([(r[0], r[1]) for r in rows])
    assert {r.vec_id: (bytes(r.code), r.error) for r in out.collect()} == want and books.reshape(-1).tolist() == flat
    assert report[0] == 8 * 800 and all(n < 8 * 800 for n in report[1:]) and sum(report[4:]) < 8 * 800


def test_net_displacement_is_tighter_than_drifts():
    rng = np.random.default_rng(2)
    history = np.cumsum(rng.integers(-50, 50, (6, 16, 4)), axis=0)
    b = vector_codes.Bounds(history)
    steps = np.sqrt((np.diff(history, axis=0).astype(float) ** 2).sum(axis=2))
    assert (b.moved[0] <= steps.sum(axis=0) + 1e-6).all() and (b.moved[0] < steps.sum(axis=0) * 0.9).any()
    x = rng.integers(-200, 200, (500, 4))
    code, near, next_ = vector_codes.nearest(x, history[2])
    sure = b.apart(code, near, np.full(500, 2), next_, np.full(500, 2))
    now, d, second = vector_codes.nearest(x, history[-1])
    assert (now[sure] == code[sure]).all()


def test_vectors_that_take_no_part_and_ties(spark):
    good = [[float(x) for x in np.repeat(v, 2)] for v in np.arange(40).reshape(5, 8)]
    rows = [(i, good[i % 5], 1 if i % 2 else None, None, 3) for i in range(23)]
    odd = [(100, None, 1, None, 1), (101, [float("nan")] * 16, 1, None, 1), (102, [1.0] * 15 + [None], 1, None, 1), (103, [float("inf")] * 16, None, None, 1), (104, [], 1, None, 1), (105, [1.0] * 8, 1, None, 1)]
    out, _ = coded(spark, rows + odd)
    got = {r.vec_id: (bytes(r.code), r.error) for r in out.collect()}
    assert got == brute_codes([(r[0], r[1]) for r in rows])[0]
    told_ = vector_codes.with_label_error(coded(spark, rows)[0]).collect()
    for r in told_:
        assert r.label_error == sum(e for i, (_, e) in got.items() if (i % 2 == 0) == (r.label is None))
    assert coded(spark, [])[0].count() == 0 and coded(spark, [odd[0]])[0].count() == 0
    few, books = coded(spark, rows[:3])
    assert books.shape == (8, 3, 2) and {r.error for r in few.collect()} == {0}
    uneven, books = coded(spark, [(i, [1.0, -2.0, float(i)], 1, None, 1) for i in range(20)])
    assert books.shape[2] == 1 and uneven.count() == 20


def test_vectors_of_any_size_and_repeated_ids(spark):
    vectors = clustered(60, 16, 4, 1e30)
    out, books = coded(spark, [(i, v, 1, None, 1) for i, v in enumerate(vectors)])
    want, flat = brute_codes(list(enumerate(vectors)))
    got = {r.vec_id: r for r in out.collect()}
    assert {i: bytes(r.code) for i, r in got.items()} == {i: c for i, (c, _) in want.items()} and books.reshape(-1).tolist() == flat
    assert all(r.error is None for i, r in got.items() if want[i][1] >= 2**63)
    assert {r.label_error for r in vector_codes.with_label_error(out).collect()} == {None}
    same = [(7, v, None, None, None) for v in clustered(40, 8, 6)] + [(None, v, None, None, None) for v in clustered(5, 8, 7)]
    assert coded(spark, same)[0].count() == 45


# token counts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def test_token_counts_of_given_documents(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    t = library()
    want = {i: (len(x.encode()), n, n > 1024) for i, x in docs.items() for n in [len(t.encode(x, add_special_tokens=False).ids)]}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries()["op13_token_counts"](spark, DATA).collect()} == want


@pytest.mark.parametrize("bounds", [{}, {"chunk_bytes": 900, "chunk_entries": 15, "buckets": 5}])
def test_token_counts_of_odd_texts(spark, bounds):
    rng = random.Random(11)
    bits = ["a", "b", " ", "\n", "\t", "'s", "'ll", "'", "9", "²", "é", "漢", "՘", "぀", "<|endoftext|>", "<|endoftext", "  ", "\r", "\x1c", "​", "　", "\u0085", "\U0001f600", "word ", " xyzzy", "!!", "\x00", "�"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(800)]
    texts += [None, "", "x" * 40_000, "ab cd" * 40_000, "zq " * 100_000, "<|endoftext|>" * 300, *["one text of many"] * 1500]
    df = spark.createDataFrame([(None if i % 7 == 0 else i % 100, x, 5, "n", x) for i, x in enumerate(texts)], "doc_id long, text string, N_BYTES int, Chunk string, copy string")
    got = token_counts.count_tokens(df, **bounds)
    assert got.columns == ["doc_id", "Chunk", "copy", "n_bytes", "n_tokens"]
    t, seen = library(), got.collect()
    assert Counter(r.copy for r in seen) == Counter(texts)
    for r in seen:
        assert (r.n_bytes, r.n_tokens) == (len((r.copy or "").encode()), len(t.encode(r.copy or "", add_special_tokens=False).ids)), r.copy[:60]
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_characters_that_both_split_alike():
    pre = token_counts.PreTokens(token_counts.default_vocabulary())
    plain = regex.compile(token_counts._PLAIN.pattern[:-1])
    chars = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if plain.fullmatch(c)]
    assert len(chars) > 30_000
    for c in chars:
        s = f"a{c}b 1{c}2 .{c}. {c}"
        assert [len(x) for x in pre.find(s)] == [j - i for _, (i, j) in pre.library_split(s)], hex(ord(c))


def test_windows_split_like_the_whole(monkeypatch):
    monkeypatch.setattr(token_counts, "WINDOW", 5)
    pre, rng = token_counts.PreTokens(token_counts.default_vocabulary()), random.Random(3)
    for _ in range(500):
        s = "".join(rng.choice([" ", "a", "'s", "\n", "1", "<|endoftext|>", "."]) for _ in range(60))
        parts = list(pre.windows(s))
        assert "<|endoftext|>".join(s.split("<|endoftext|>")) == s and sum(n for _, n in parts) == s.count("<|endoftext|>")
        assert [p for w, _ in parts for p in pre.split(w)] == [p for w in s.split("<|endoftext|>") for p in pre.split(w)]


def test_places_and_counts_are_packed_without_loss():
    rng = np.random.default_rng(5)
    for top in (10, 70_000, 5_000_000):
        at = np.unique(rng.integers(0, top, 500))
        assert (token_counts.unpack(token_counts.pack(at)) == at).all()
    n = np.array([1, 254, 255, 256, 100_000, 3])
    assert (token_counts.unpack_counts(token_counts.pack_counts(n), 6) == n).all()
