import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from aeroframe.llm.ann import BITS, KEYS, SUB, Cell, Directory, codes, flips, learn_rotations, lengthened, reaches, search
from aeroframe.llm.q_ann import op4_nearest_neighbours

GIVEN = os.environ.get("TEST_ANN_DIR", "/root/testdata/sf0.1")


def brute(ids, vs, q, k):
    out = {}
    for i in q:
        s = [(-float(np.dot(vs[i], vs[j])), j) for j in ids if j != i]
        out[i] = [j for _, j in sorted(s)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_recall_on_isotropic_and_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    for lengths in (False, True):
        x = rng.standard_normal((3000, 32))
        x[:600] = x[0] + 0.05 * rng.standard_normal((600, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if lengths:
            x *= rng.uniform(0.5, 2, (3000, 1))
        x = x.astype(np.float32)
        got = search(frame(spark, [(i, v.tolist(), "s") for i, v in enumerate(x)]), F.col("id") % 20 == 0, cell=300).collect()
        want = brute(range(3000), x.astype(float), range(0, 3000, 20), 20)
        found = {}
        for r in got:
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
        hits = sum(len({j for _, j, _ in v} & set(want[i])) for i, v in found.items())
        assert hits / (20 * len(want)) >= 0.93
        for i, v in found.items():
            v.sort()
            assert [s for _, _, s in v] == sorted((s for _, _, s in v), reverse=True)
            assert all(abs(s - np.dot(x[i].astype(float), x[j].astype(float))) < 1e-12 for _, j, s in v)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (20, [1.0, 0.0], "b"), (1, [0.5, 0.5], None), (1, [0.5, 0.5], None), (2, None, "x"), (3, [], "x"), (4, [0.0, 0.0], "x"),
            (5, [float("nan"), 1.0], "x"), (6, [1.0, None], "x"), (7, [1.0, 2.0, 3.0], "x"), (None, [1.0, 1.0], "x"), (8, [1.0, 0.0], "t")]
    got = [(r.query_id, r["rank"], r.vec_id) for r in search(frame(spark, rows), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8), (0, 2, 20), (0, 3, 1), (20, 1, 0), (20, 2, 8), (20, 3, 1)]
    assert search(frame(spark, []), F.col("id") % 20 == 0).count() == 0


def given_vectors():
    t = pq.read_table(f"{GIVEN}/embeddings.parquet").to_pandas()
    return t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="needs the given tables")
def test_registered_query_on_the_given_table(spark):
    ids, x = given_vectors()
    got = op4_nearest_neighbours(spark, GIVEN)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append(r)
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(found) == set(ids[asked].tolist())
    hits = 0
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        rows = sorted(found[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {r.vec_id for r in rows})
    assert hits / (20 * len(asked)) >= 0.93


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="needs the given tables")
def test_probes_list_all_within_the_radius_and_fewer_than_all_pairs():
    ids, x = given_vectors()
    code = codes(lengthened(x, 1.0), learn_rotations(lengthened(x, 1.0), BITS))
    q = np.flatnonzero(ids % 20 == 0)
    whole = np.bitwise_count(code[q][:, None] ^ code[None]).sum(axis=2)
    for radius in (12, 20, 28):
        reach = reaches(radius, BITS // SUB)
        assert sum(r + 1 for r in reach) == radius + 1
        found, listed = [], np.zeros(whole.shape, bool)
        for k in range(BITS // SUB):
            cell, masks = Cell(np.arange(len(ids)), code, x, k), flips(reach[k])
            at, row = cell.listed(code[q], masks)
            listed[at, cell.ids[row]] = True
            at, row = cell.within(code[q], masks, reach, radius)
            found += zip(at.tolist(), cell.ids[row].tolist())
        assert len(found) == len(set(found))  # no pair twice
        assert set(found) == set(zip(*(w.tolist() for w in np.nonzero(whole <= radius))))
        assert listed.sum() < {12: 0.1, 20: 0.4, 28: 0.8}[radius] * listed.size


def test_directory_splits_hot_keys_and_keeps_cells_even():
    rng = np.random.default_rng(5)
    code = rng.integers(0, KEYS, (40_000, 2)).astype(np.uint16)
    code[:15_000] = code[0]
    ids = np.arange(len(code))
    counts = np.stack([np.bincount(code[:, k], minlength=KEYS) for k in range(2)])
    d = Directory(counts, 4096)
    for k in range(2):
        cells = d.of_row(ids, code, k)
        assert (cells >= 0).all() and np.bincount(cells).max() <= 1.3 * 4096
        masks = flips(2)
        asked = set(d.of_query(int(code[0, k]), masks, k).tolist())
        near = np.bitwise_count(code[:, k] ^ code[0, k]) <= 2
        assert set(cells[near].tolist()) <= asked


def test_few_candidates_and_clashing_names(spark):
    rows = [(i, [float(i % 3 + 1), 1.0, -float(i)], "x", 0.5, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, CODE string, score double, QUERY_ID long")
    got = search(df, F.col("id") % 20 == 0).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 12)) and {r.vec_id for r in got} == set(range(1, 12))
    same = spark.createDataFrame([(i, [1.0, 2.0], "s") for i in range(60)], "vec_id long, embedding array<float>, score string")
    got = search(same, F.col("id") % 20 == 0).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(21) if i != 20]
