"""The registered queries on whole small tables: columns, and results against brute force where SQL has no form."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import regex

from aeroframe.llm import oracle_sql, pii, queries, url_filter

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given tables")
COLUMNS = {
    "op1_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"], "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_nearest_neighbours": ["query_id", "rank", "vec_id", "score"], "op5_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op6_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_minhash_dedup": ["doc_id", "n_shingles", "component_id", "kept"], "op8_url_filter": ["page_id", "host", "path", "rule", "verdict"], "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op10_pii": ["doc_id", "text"],
    "op11_source_divergence": ["lang", "source", "part", "item", "value", "rank"], "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"], "op13_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


def given(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries()[name](spark, DATA)
    assert set(COLUMNS[name]) <= set(df.columns)
    if name == "op11_source_divergence":
        return
    ids = sorted(r[0] for r in df.select(COLUMNS[name][0]).collect())
    if name == "op5_chat_format":
        assert ids == sorted({r["conv_id"] for r in given("conversations")} | {-1})
    elif name == "op4_nearest_neighbours":
        asked = [r["vec_id"] for r in given("embeddings") if r["vec_id"] % 20 == 0]
        assert sorted(set(ids)) == sorted(asked)
    else:
        table, key = {"op8_url_filter": ("pages", "page_id"), "op12_vector_codes": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
        assert ids == sorted(r[key] for r in given(table))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel, df = con.sql(oracle_sql()[name]), queries()[name](spark, DATA)
    cols = sorted(rel.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())


def test_language_of_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in given("documents")}
    right = n = 0
    for r in queries()["op3_language_id"](spark, DATA).collect():
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r.lang_pred == "und"
        elif r.held_out and d["lang"] is not None:
            n, right = n + 1, right + (r.lang_pred == d["lang"])
    assert n >= 20 and right / n >= 0.97


def brute_verdicts(urls, folds):
    """{url: verdict} by rules, else by two Witten-Bell models learned from what rules decide."""

    def rule(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(len(h + p), k) for k, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    def grams(text):
        s = url_filter.START * 4 + text + url_filter.END
        return [s[i : i + 5] for i in range(len(text) + 1)]

    text = {u: (u.split("://", 1)[1] if "://" in u else u) if u else "" for u in urls}
    count = {}
    for u in urls:
        key = (text[u], rule(u))
        count[key] = count.get(key, 0) + 1
    seen = {"allow": {}, "block": {}}
    follow = {"allow": {}, "block": {}}
    for (t, v), n in count.items():
        if v and folds[t] > 0:
            for g in grams(t):
                for k in range(5):
                    s = g[-k - 1 :]
                    seen[v][s] = seen[v].get(s, 0) + n
    for v in seen:
        for s, n in seen[v].items():
            c, kinds = follow[v].get(s[:-1], (0, 0))
            follow[v][s[:-1]] = (c + n, kinds + 1)

    def prob(g, v):
        p = 1 / 256
        for k in range(5):
            s = g[-k - 1 :]
            c, kinds = follow[v].get(s[:-1], (0, 0))
            if c:
                p = (seen[v].get(s, 0) + kinds * p) / (c + kinds)
        return p

    def score(t):
        return sum(math.log(prob(g, "allow")) - math.log(prob(g, "block")) for g in grams(t)) / (len(t) + 1)

    kept = {v: sorted(score(t) for t, w in count if w == v and folds[t] == 0) for v in seen}
    at = lambda xs, p: xs[max(math.ceil(p * len(xs)), 1) - 1]
    cut = (at(kept["allow"], 0.05) + at(kept["block"], 0.95)) / 2 if kept["allow"] and kept["block"] else None
    return {u: rule(u) or ("block" if cut is not None and score(text[u]) < cut else "allow") for u in urls}, cut


def test_url_verdicts(spark, tmp_path):
    rng = random.Random(5)
    urls = [r["url"] for r in given("pages")]
    urls += [f"https://{rng.choice(['good', 'fine'])}{rng.randrange(30)}.org/read/{rng.randrange(99)}" for _ in range(150)] + [f"http://spam{rng.randrange(30)}.com/de/win/{rng.randrange(99)}" for _ in range(150)]
    urls += [f"http://spam{rng.randrange(30)}.net/win/{rng.randrange(99)}" for _ in range(40)] + [f"https://fine{rng.randrange(30)}.net/read/{rng.randrange(99)}" for _ in range(40)] + [None, "", "plain", "http://x.net/" + "a" * 20000] + ["http://same.net/win"] * 1500
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    texts = sorted({(u.split("://", 1)[1] if "://" in u else u) if u else "" for u in urls})
    folds = {r.t: r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "pmod(xxhash64(t), 5) AS f").collect()}
    want, cut = brute_verdicts(urls, folds)
    assert cut is not None
    got = queries()["op8_url_filter"](spark, str(tmp_path)).collect()
    assert len(got) == len(urls) and {r.page_id: r.verdict for r in got} == {i: want[u] for i, u in enumerate(urls)}
    assert {want[u] for u in urls if u and ".net" in u} == {"allow", "block"}


def test_personal_data_of_the_whole_table(spark):
    """Between mentions texts stay as they are; an entity has one surrogate everywhere, and no two of a kind share one."""
    entity, docs = regex.compile(pii.ENTITY), {r["doc_id"]: r["text"] for r in given("documents")}
    digits = lambda s: regex.sub(r"\D", "", s)
    forward, back, n = {}, {}, 0
    for r in queries()["op10_pii"](spark, DATA).collect():
        old = docs[r.doc_id]
        if old is None:
            assert r.text is None
            continue
        found = [m[0] for m in entity.finditer(old)]
        assert r.n_entities == len(found)
        if not found:
            assert r.text == old
            continue
        pieces, at, new = entity.sub("\0", old).split("\0"), 0, []
        for k, piece in enumerate(pieces):
            nxt = r.text.find(piece, at) if piece else (at if k == 0 else len(r.text) if k == len(pieces) - 1 else at)
            assert nxt >= at
            if k:
                new.append(r.text[at:nxt])
            at = nxt + len(piece)
        assert at == len(r.text)
        for a, b in zip(found, new):
            n += 1
            if regex.fullmatch(pii.EMAIL, a):
                a, b, kind = a.lower(), b.lower(), "email"
                assert regex.search(r"\.example\.(com|net|org)$", b)
            elif regex.fullmatch(pii.CARD, a) and not regex.fullmatch(pii.PHONE, a):
                assert regex.sub(r"\d", "9", a) == regex.sub(r"\d", "9", b) and a != b
                a, b, kind = digits(a), digits(b), "card"
                assert sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(b[::-1], 1)) % 10 == 0
            else:
                continue
            assert forward.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a
    assert n > 0 and forward


def test_conversation_of_control_strings(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    r = queries()["op5_chat_format"](spark, DATA).where("conv_id = -1").first()
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_conversations_of_the_whole_table(spark):
    """Turns and what is trained on, from the given rows alone."""
    turns = {}
    for r in given("conversations"):
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = {r.conv_id: r for r in queries()["op5_chat_format"](spark, DATA).collect()}
    assert set(got) == set(turns) | {-1}
    for i, rows in turns.items():
        rows = [r[1:] for r in sorted(rows, key=lambda r: r[0])]
        said = "".join(t for role, t in rows if role == "assistant")
        assert (got[i].n_turns, got[i].turns_sha256) == (len(rows), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in rows).encode()).hexdigest())
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[i].formatted_chars >= sum(len(a) + len(t) for a, t in rows)


def test_planted_entities_of_every_kind(spark):
    """Entities that this test makes itself: each goes, alike everywhere, unlike any other, in its own form."""
    made = {
        "email": ["a.b@corp.org", "x@y.net"], "phone": ["+49 30 1234567", "+1 (264) 555-1012"], "iban": ["DE89 3704 0044 0532 0130 00"], "ip": ["78.241.210.149", "91.12.33.7"],
        "card": ["4539 1488 0343 6467"], "name": ["Dr Jane Doe", "Mr Paul Miller"], "secret": ["password = hunter2secret9"],
    }
    rows, of = [], []
    for kind, values in made.items():
        for v in values:
            for k in range(2):
                of.append((kind, v))
                rows.append((len(rows), f"Note {k} holds ({v}) and goes on."))
    got = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    seen = {}
    for i, (kind, v) in enumerate(of):
        m = re.fullmatch(r"Note \d holds \((.*)\) and goes on\.", got[i])
        assert m and m[1] != v, (kind, got[i])
        assert seen.setdefault((kind, v), m[1]) == m[1]
        if kind in ("iban", "card"):
            assert re.sub(r"\d", "9", m[1])[-6:] == re.sub(r"\d", "9", v)[-6:] and len(m[1]) == len(v)
        elif kind == "phone":
            assert m[1].startswith("+") and len(re.sub(r"\D", "", m[1])) == len(re.sub(r"\D", "", v))
        elif kind == "ip":
            assert all(int(x) < 256 for x in m[1].split(".")) and m[1].count(".") == 3
        elif kind == "name":
            assert m[1].split(" ")[0] == v.split(" ")[0] and len(m[1].split(" ")) == 3
        elif kind == "secret":
            assert m[1].startswith("password = ") and len(m[1]) == len(v)
    assert len(set(seen.values())) == len(seen)


def test_mix_of_the_whole_table(spark):
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in given("documents")}
    source = {r["doc_id"]: r["source"] for r in given("documents")}
    got = queries()["op6_mix_sources"](spark, DATA).collect()
    taken, target = {}, {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"])
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    most = max(size.values())
    assert all(abs(taken[s] - target[s]) <= most for s in taken) and abs(sum(target.values()) - min(1.5 * sum(size.values()), sum(target.values()))) < 1e-6
    assert np.isclose(sum(target.values()), 1.5 * sum(size.values()))
