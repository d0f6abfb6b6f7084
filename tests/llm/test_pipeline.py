"""The pipeline against its stages' brute-force forms, on odd rows too."""

import hashlib
import random
import string

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from aeroframe.llm import bpe

from .test_documents import brute_components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(11)
    words = {"en": "the and of thing order ration", "fr": "eau le une ouais éclat être"}
    out = []
    for i in range(160):
        lang = rng.choice(list(words))
        lines = [" ".join(rng.choice(words[lang].split()) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(4, 30))) for _ in range(rng.randrange(1, 5))]
        out.append((i, "\n".join(lines + ["A license line of all documents"] * (i % 3 == 0)), lang, f"src{i % 3}" if i % 11 else None, 0))
    out += [(500 + i, out[7][1].replace("the", "The"), "en", "src0", 0) for i in range(20)]
    return out + [(900, None, "en", "src1", 0), (901, "", None, None, None), (902, "word thing " * 12000, "en", "src2", 0), (7, *out[7][1:])]


def test_pipeline(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Language ID rejects null and empty text only; then lines, then one document of each group.
    kept = [(i, t) for i, t, *_ in data if t]
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    first = {}
    for i, t in kept:
        for line in t.split("\n"):
            first[key(line)] = min(i, first.get(key(line), i))
    lined = [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i)) for i, t in kept]
    stay = {i for i, _, c, ok in brute_components(lined) if ok}
    texts = {i: t for i, t in lined if i in stay}
    ranks = bpe.Bpe(*bpe.default_vocabulary()).ranks
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id for r in got} <= stay
    counts = {}
    for r in got:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 2 and len(got) > 0.8 * len(stay)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "bpe" or out.columns == empty.columns), name
    odd = spark.createDataFrame([(1, "some words of text here", "en", "s", 3, "x", 4), (None, None, None, None, None, None, None)], SCHEMA + ", id string, lead int")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns, name


def test_near_stage_keeps_texts_without_an_own_id(spark, tmp_path):
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"{k}{rng.randrange(900)}" for _ in range(60)) for k in "abcde")
    data = [(None, a, "en", "s", 1), (None, a, "en", "r", 1), (None, b, "en", "s", 1), (None, c + " more", "en", "s", 1), (1, c, "en", "s", 1), (2, d, "en", "s", 1), (2, e, "en", "s", 1), (2, e, "en", "r", 1), (3, b + " end", "en", "s", 1)]
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame(data, SCHEMA), str(tmp_path)).collect()
    # 1 and 3 stay apart though each is near a text without id.
    assert sorted((r.doc_id or 0, r.text, r.source) for r in got) == sorted([(0, a, "r"), (1, c, "s"), (2, d, "s"), (2, e, "r"), (3, b + " end", "s")])
