"""Operators on documents against brute force, with the odd rows of every contract."""

import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from aeroframe.llm import exact_dedup, language_id, line_dedup, minhash_dedup, mixing, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def docs(spark, texts, source="a"):
    rows = [(i, t, "en", source if isinstance(source, str) else source[i % len(source)], len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "dé", "ÀB", "x", "the", "of", "lorem", "ipsum"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        t = base[rng.randrange(12)]
        w = t.split(" ")
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        t = rng.choice([" ", "  ", "\t"]).join(w)
        lines = [t, "A shared Line of text " + str(rng.randrange(3)), rng.choice(base), "short"]
        out.append((i, "\n".join(rng.sample(lines, rng.randrange(1, 4)))))
    return out + [(1000, None), (1001, ""), (1002, "\n"), (1003, " \t "), (1004, "word " * 30000), (1005, "a b c"), (1006, "a b c"), (5, out[5][1])]


def test_line_dedup(spark):
    rows = corpus()
    keyed = {}
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            keyed.setdefault(key(line), set()).add(i)
    want = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(keyed[key(x)]) == i]
        want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    for batches in (1, 4, 7):
        out = line_dedup.dedup_lines(docs(spark, rows), batches=batches)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
        got = out.collect()
        assert len(got) == len(rows) and all((r.n_lines, r.n_dropped, r.text) == want[r.doc_id] for r in got)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_exact_dedup(spark):
    rows = corpus() + [(2000 + i, "one  hot \n text") for i in range(200)] + [(2500, "one hot text")]
    groups = {}
    for i, t in rows:
        groups.setdefault(WS.sub(" ", t or ""), []).append(i)
    got = exact_dedup.duplicate_groups(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {(i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    assert exact_dedup.duplicate_groups(docs(spark, [])).count() == 0


def brute_components(rows, n=5):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = [x for x in WS.split((t or "").translate(LOWER)) if x]
        sets[k] = (i, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    top = {i: i for i, _ in rows}

    def root(c):
        while top[c] != c:
            c = top[c]
        return c

    for a in sets:
        for b in sets:
            (i, s), (j, t) = sets[a], sets[b]
            if a < b and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return [(i, len(s), root(i), root(i) == i) for i, s in sets.values()]


def test_minhash_dedup(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = corpus(60, 4)
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        rows.append((3000 + i, " ".join(w)))
    got = minhash_dedup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(brute_components(rows))
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_minhash_blocks_find_what_pairs_find(spark, monkeypatch):
    rows = [(i, " ".join(f"c{j}" if j < 60 else f"d{i}_{j}" for j in range(60 + i % 25))) for i in range(80)]
    want = sorted(brute_components(rows))
    for few in (0, 1000):
        monkeypatch.setattr(minhash_dedup, "FEW", few)
        got = minhash_dedup.near_duplicates(docs(spark, rows)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice(["b", "a", "c", "c", "c", "c", None]), 0) for i in range(3000)]
    rows += [(9000, None, "en", "d", 0), (9001, "x y", "en", "e", 0), (9001, "x y", "en", "e", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df, fan_in=16)
    got = out.collect()
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, total, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= share
    assert sum(r.n_rows for r in got) == len(rows)
    taken, largest = {}, {}
    for r in got:
        s = None if r.sk == "1" else r.sk[1:]
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and 0 <= r.copies <= 2
        taken[s] = taken.get(s, 0) + r.copies * r.size * r.n_rows
        largest[s] = max(largest.get(s, 0), r.size * r.n_rows)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, fan_in=16).collect()))
    repeated = mixing.apply_mix(df, out).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in repeated} == {r.id: r.copies * r.n_rows for r in got if r.copies}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_is_fair(spark):
    """Every document's mean number of copies over seeds is its source's share."""
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "en", "a" if i % 3 else "b", 0) for i in range(60)], SCHEMA)
    n, total = 12, {}
    for seed in range(n):
        for r in mixing.mix(df, seed=seed, fan_in=8).collect():
            total.setdefault(r.sk, []).append(r.copies - r.target / r.source_size)
    assert all(abs(sum(v) / len(v)) < 0.12 for v in total.values())


def test_url_rules(spark):
    urls = [(1, "http://Www.Example.ORG/es/1?q#f", "allow?"), (2, "https://example.org/en/12", ""), (3, "http://x.org/a", ""), (4, "http://a.com/fr/1", ""), (5, "http://a.com/de/1", ""), (6, None, ""), (7, "no scheme", ""), (8, "http://org", ""), (9, "http://notexample.org/es/", ""), (10, "http://h?x/y", ""), (11, "", ""), (3, "http://x.org/a", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string, score string")).collect()}
    assert got == {
        1: ("www.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("x.org", "/a", "org/", "allow"), 4: ("a.com", "/fr/1", "com/fr/", "allow"),
        5: ("a.com", "/de/1", "com/de/", "block"), 6: ("", "", None, got[6][3]), 7: ("", "", None, got[7][3]), 8: ("org", "", None, got[8][3]), 9: ("notexample.org", "/es/", "org/", "allow"), 10: ("h", "", None, got[10][3]), 11: ("", "", None, got[11][3]),
    }
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_against_brute_force(spark):
    import math

    learn = [("aab", 3, 0), ("abc", 0, 2), ("bca/x", 1, 1)]
    rows = [(g, float(a), float(r)) for t, a, r in learn for g in _grams(t)]
    df = spark.createDataFrame(rows, "gram string, a double, r double").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    probe = sorted(set(_grams("aabc/")))
    got = {r.gram: r.ratio for r in url_filter.gram_scores(spark.createDataFrame([(g,) for g in probe], "gram string"), url_filter.model(df, 4), 4).collect()}

    def prob(gram, which):
        p = 1 / 256
        for k in range(5):
            s = gram[-k - 1 :]
            ctx, c = s[:-1], s[-1]
            follow = {}
            for g, a, r in rows:
                if (v := (a, r)[which]) and g[-k - 1 :][:-1] == ctx:
                    follow[g[-1]] = follow.get(g[-1], 0) + v
            if follow:
                p = (follow.get(c, 0) + len(follow) * p) / (sum(follow.values()) + len(follow))
        return p

    for g in probe:
        assert got[g] == pytest.approx(math.log(prob(g, 0)) - math.log(prob(g, 1)), abs=1e-9)


def _grams(text):
    s = url_filter.START * 4 + text + url_filter.END
    return [s[i : i + 5] for i in range(len(text) + 1)]


def test_language_id(spark):
    rng = random.Random(3)
    words = {"en": "the and of ing th ed er", "de": "der und sch ung ein ß ü", "ru": "при ста ов ть ся"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(words))
        rows.append((i, " ".join("".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), lang, "s", "c"))
    odd = [(1000, None, "en", "s", "c"), (1001, "", None, "s", "c"), (1002, "123 !!", "en", "s", "c"), (1003, "the and " * 30000, None, "s", "c"), (1004, "漢字漢字漢字", None, "s", "c")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, score string")
    model = language_id.fit_on_documents(df)
    out = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    held = [r for r in rows if out[r[0]].doc_id is not None]
    assert sum(out[i].lang_pred == lang for i, _, lang, _, _ in held) / len(held) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (1000, 1001, 1002))
    assert out[1003].lang_pred == "en" and not out[1003].rejected and out[1004].rejected
    assert all(0 <= r.score <= 1 for r in out.values())
    empty = language_id.fit_on_documents(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, empty).collect()} == {"und"}
