import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from aeroframe.llm import bpe as M

PATH, PATTERN = M.default_vocabulary()


@pytest.fixture(scope="module")
def both():
    own = M.Bpe(PATH, PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


def texts():
    rng = random.Random(5)
    yield from ["", " ", "\n\n  x", "a" * 5000, "ab" * 9000, "日本語" * 4000, "don't I'll 12 ab12  \t\n x", "<|endoftext|>", "\x1c\x1d \x85 x", "é" * 20000]
    for alphabet in ("ab ", "the and\n'12é", "xyzèß日本 \t\n.,!", "aaaab", "ÿþ　 a b"):
        for n in (10, 300, 9000, 30000):
            yield "".join(rng.choice(alphabet) for _ in range(n))


def test_matches_tiktoken_and_round_trips(both):
    own, tik = both
    for t in texts():
        got = ids(own, t)
        assert got == tik.encode_ordinary(t), t[:60]
        assert own.decode(got).decode() == t


def test_every_code_point_splits_alike(both):
    own, tik = both
    for at in range(0, 0x3000, 64):
        t = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(at, at + 64))
        assert ids(own, t) == tik.encode_ordinary(t), hex(at)


def test_every_token_encodes_to_itself(both):
    """The lemma that the joins of long matches rest on needs it."""
    own, _ = both
    assert all(own.merge(t) == [r] for t, r in own.ranks.items() if len(t) <= 40)


def test_operator(spark, both):
    _, tik = both
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (4, "a b " * 9000, "z"), (4, "a b " * 9000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = M.round_trip(df).collect()
    decoded = {r.doc_id: bytes(r.decoded) for r in M.decode(M.encode(df)).collect()}
    assert decoded == {i: (t or "").encode() for i, t, _ in rows}
    assert len(out) == 5
    for r in out:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        want = tik.encode_ordinary(text)
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert M.round_trip(df.limit(0)).count() == 0
