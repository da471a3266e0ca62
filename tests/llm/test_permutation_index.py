"""Nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest

from tessera.llm import permutation_index as index

QUERIES = "id % 20 = 0"
SCHEMA = "vec_id long, embedding array<float>, id long, e string, entry long, block int, perm string, score double"


def table(spark, pairs):
    return spark.createDataFrame([(i, e, 1, "x", 2, 3, "y", 0.5) for i, e in pairs], SCHEMA).repartition(3)


def answers(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def brute(pairs, k=20):
    """Neighbours of each query among distinct rows."""
    ids = np.array([i for i, _ in pairs])
    vectors = np.array([e for _, e in pairs], np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[q]
        out[int(ids[q])] = [(int(ids[j]), scores[j]) for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:k]
    return out


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_recall_and_scores(spark, name):
    vectors = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    pairs = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    got, want = answers(index.nearest(vectors, QUERIES)), brute(pairs)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {i: np.array(e, np.float32).astype(np.float64) for i, e in pairs}
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(math.isclose(s, exact[q] @ exact[v], rel_tol=1e-12) for _, v, s in rows)


def test_several_blocks_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    pairs = [(int(i), (centres[i % 30] * (1 + i % 4) + rng.normal(size=16) * 0.3).tolist()) for i in range(3000)]
    monkeypatch.setattr(index, "BLOCK", 400)
    monkeypatch.setattr(index, "BATCH", 40)
    got, want = answers(index.nearest(table(spark, pairs), QUERIES)), brute(pairs)
    assert sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / 20 / len(want) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rng = random.Random(1)
    one, other = [1.0, 2.0, 0.5], [0.5, 0.25, 3.0]
    pairs = [(i, one) for i in range(0, 90, 3)] + [(i, other) for i in range(1, 90, 3)] + [(i, [rng.random() for _ in range(3)]) for i in range(2, 90, 3)]
    odd = [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 2.0]), (180, [1.0, float("nan"), 2.0]), (200, [float("inf"), 1.0, 1.0]), (220, [9.0, 9.0]), (None, one)]
    got = answers(index.nearest(table(spark, pairs + odd + pairs[:5]), QUERIES))
    want = brute(pairs)
    assert {q: [v for _, v, _ in rows] for q, rows in got.items()} == {q: [v for v, _ in rows] for q, rows in want.items()}


def test_few_and_no_rows(spark):
    got = answers(index.nearest(table(spark, [(20, [1.0, 0.0]), (7, [-1.0, 0.0]), (3, [-1.0, 0.0])]), QUERIES))
    assert [(r, v) for r, v, _ in got[20]] == [(1, 3), (2, 7)]
    assert answers(index.nearest(table(spark, [(20, [1.0, 0.0])]), QUERIES)) == {}
    assert answers(index.nearest(table(spark, [(7, [1.0, 0.0]), (8, [0.5, 0.0])]), QUERIES)) == {}
    none = index.nearest(table(spark, [(20, None)]), QUERIES)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
