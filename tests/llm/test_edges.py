"""Rows that every operator must take: no ids, repeated ids, clashing names, very long texts."""

import random

from pyspark.sql import functions as F

from aeroframe.llm import bpe, exact_dedup, language_id, line_dedup, minhash_dedup, mixing, pii, url_filter

LINE = "a licence line that many share"


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def writes(df, tmp_path):
    """A result whose names clash in case could not be written."""
    df.write.mode("overwrite").parquet(str(tmp_path / "out"))
    return df.sparkSession.read.parquet(str(tmp_path / "out")).collect()


def test_lines_of_rows_without_ids(spark):
    rows = [(None, f"{LINE}\nfirst own line here"), (None, f"{LINE}\nsecond own line here"), (None, None), (3, LINE), (3, f"{LINE}\nthird own line here")]
    got = sorted((r.doc_id or 0, r.text, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    # Of one id, all rows keep the line; rows without an id come after all ids.
    assert got == sorted([(0, "first own line here", 1), (0, "second own line here", 1), (0, "", 0), (3, LINE, 0), (3, f"{LINE}\nthird own line here", 0)])


def test_names_that_clash(spark, tmp_path):
    rows = [(1, f"{LINE}\nJohn Doe, call +1 (264) 555-1012", 7, "x", 2.0), (2, f"{LINE}\nmore", 8, None, None)]
    lines = frame(spark, rows, ", N_LINES int, N_dropped string, h1 double")
    got = {r.doc_id: r for r in writes(line_dedup.dedup_lines(lines), tmp_path)}
    assert (got[2].n_lines, got[2].n_dropped, got[2].text) == (2, 1, "more")
    hidden = frame(spark, rows, ", N_ENTITIES int, __pii string, digest double")
    out = writes(pii.replace_pii(hidden.drop("__pii"), "k").drop("digest"), tmp_path)
    assert {r.doc_id: r.n_entities for r in out} == {1: 2, 2: 0}
    odd = frame(spark, rows, ", SIZE int, KEPT string, sk double")
    assert {r.id: r["size"] for r in mixing.mix(odd.withColumn("source", F.lit("a"))).collect()} == {1: 12, 2: 7}
    assert mixing.apply_mix(odd.withColumn("source", F.lit("a")), mixing.mix(odd.withColumn("source", F.lit("a")))).columns == [*odd.columns, "source"]
    assert {r.doc_id for r in writes(exact_dedup.duplicate_groups(frame(spark, rows, ", KEEP_ID int, norm string, salt double")), tmp_path)} == {1, 2}
    assert {r.doc_id for r in writes(minhash_dedup.near_duplicates(frame(spark, rows, ", COMPONENT_ID int, cls string, rep double")), tmp_path)} == {1, 2}
    ids = frame(spark, rows, ", IDS int, N_TOKENS string, Decoded double")
    assert {r.doc_id for r in writes(bpe.round_trip(ids), tmp_path)} == {1, 2}
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "v")], "page_id long, url string, HOST string, Verdict string")
    assert writes(url_filter.judge(pages), tmp_path)[0].verdict == "allow"
    docs = spark.createDataFrame([(i, f"the and thing {i}" if i % 2 else f"der und sch {i}", "en" if i % 2 else "de", 1.0, "x") for i in range(80)], "doc_id long, text string, lang string, SCORE double, Lang_Pred string")
    assert len(writes(language_id.identify(docs, language_id.fit_on_documents(docs)), tmp_path)) == 80


def test_ids_that_are_missing_or_repeat(spark):
    rows = [(None, "same text of some words here"), (None, "same text of some words here"), (None, "wholly other words stand in this one"), (4, "same text of some words here"), (4, "wholly different again from all others here"), (5, "")]
    got = exact_dedup.duplicate_groups(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == sorted([(0, 4, 3, False), (0, 4, 3, False), (4, 4, 3, True), (0, 0, 1, True), (4, 4, 1, True), (5, 5, 1, True)])
    near = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near) == sorted([(0, 4, False), (0, 4, False), (0, 0, True), (4, 4, True), (4, 4, True), (5, 5, True)])
    mixed = mixing.mix(frame(spark, rows).withColumn("source", F.lit(None).cast("string"))).collect()
    assert sum(r.n_rows for r in mixed) == 6


def test_languages_of_one_id(spark):
    rng = random.Random(1)
    words = {"en": "the and of ing th ed er", "de": "der und sch ung ein ß ü"}
    text = lambda lang: " ".join("".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 20)))
    for one in (0, 1, 2):
        rows = [(one, text(lang), lang) for _ in range(1500) for lang in words]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language_id.fit(df, per_language=100)
        assert set(model.languages) == set(words) and len(model.languages) <= 2 * language_id.CLUSTERS
        got = language_id.identify(df, model).collect()
        assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_short_texts_are_not_rejected_for_their_length(spark):
    rng = random.Random(2)
    stems = {"en": ["walk", "think", "light", "under", "house"], "de": ["gehen", "unter", "licht", "schön", "haus"]}
    ends = {"en": ["ing", "ed", "s", ""], "de": ["en", "ung", "e", ""]}
    rows = [(i, " ".join(rng.choice(stems[g]) + rng.choice(ends[g]) for _ in range(rng.randrange(5, 60))), g) for i in range(600) for g in [rng.choice(["en", "de"])]]
    rows += [(1000, "Walking.", None), (1001, "schönen", None), (1002, "漢字漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.identify(df, language_id.fit_on_documents(df)).collect()}
    assert (out[1000].lang_pred, out[1000].rejected, out[1001].lang_pred, out[1001].rejected) == ("en", False, "de", False)
    assert out[1002].rejected


def test_a_language_of_one_row_of_digits(spark):
    rows = [(i, f"the thing and number {i}", "en") for i in range(40)] + [(100, "1 2 3 4 5 6 7 8 9 abc", "xx"), (101, "1 2 3", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert set(model.languages) == {"en", "xx"}
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, model).collect()}
    assert got[100] == "xx" and got[0] == "en" and got[101] == "und"


def test_very_long_texts(spark):
    long = "word " * 200_000
    rows = [(1, long + "a@b.org " + long), (2, long), (3, None)]
    assert {r.id: r["size"] for r in mixing.mix(frame(spark, rows).withColumn("source", F.lit("s"))).collect()} == {1: 400_001, 2: 200_000, 3: 0}
    got = {r.doc_id: r for r in pii.replace_pii(frame(spark, rows), "k").collect()}
    assert got[1].n_entities == 1 and "a@b.org" not in got[1].text and got[1].text.count("word ") == 400_000 and got[2].text == long
    assert {r.doc_id: r.n_lines for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.kept for r in exact_dedup.duplicate_groups(frame(spark, rows)).collect()} == {1: True, 2: True, 3: True}


def test_hot_texts(spark):
    """One text holds most rows: more than a key may before it is dealt to many tasks."""
    rows = [(i, "Mail me at x@y.org, or call +49 (0)30 1234567 today, please do so") for i in range(2500)] + [(5000 + i, f"row {i} of its own with a few more words") for i in range(40)] + [(6000 + i, "") for i in range(1200)]
    df = frame(spark, rows)
    near = minhash_dedup.near_duplicates(df).collect()
    assert len(near) == len(rows) and {r.component_id for r in near if r.doc_id < 2500} == {0} and all(r.kept for r in near if r.doc_id >= 5000)
    out = pii.replace_pii(df, "k").collect()
    assert len(out) == len(rows) and len({r.text for r in out if r.doc_id < 2500}) == 1 and sum(r.n_entities for r in out) == 5000
    lines = line_dedup.dedup_lines(df).collect()
    assert sum(r.n_dropped for r in lines) == 2499 and len(lines) == len(rows)
    groups = exact_dedup.duplicate_groups(df).collect()
    assert {(r.keep_id, r.group_size) for r in groups if r.doc_id < 2500} == {(0, 2500)} and sum(r.kept for r in groups) == 42


def test_names_told_by_others(spark):
    rows = [(1, "Dr Jane Doe wrote."), (2, "Mrs Jane Doe wrote."), (3, "Prof. Kim Roe wrote."), (4, "Mr Kim Roe wrote."), (5, "Dr Lee Poe wrote."), (6, "Mr Lee Poe wrote."), (7, "Mrs Lee Poe wrote."), (8, "DE89 3704 0044 0532 0130 00 and +49 30 1234567 and 78.241.210.149")]
    got = {r.doc_id: r.text for r in pii.replace_pii(frame(spark, rows), "k").collect()}
    name = lambda i: got[i].removesuffix(" wrote.").split(" ", 1)[1]
    assert name(1) == name(2) and name(3) == name(4) and len({name(5), name(6), name(7)}) == 3
    iban, _, phone = got[8].partition(" and ")
    number = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1 and phone.startswith("+49 ") and phone.split(" and ")[1].startswith("10.")
