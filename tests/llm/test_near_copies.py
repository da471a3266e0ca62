"""Near copies of the pipeline's stage against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, near_copies

from .cases import by_id, documents, empty, rows


def brute_groups(items):
    """Least id of each row's component over all pairs with Jaccard 0.8 or more of five-word shingles."""
    sets = []
    for _, text in items:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(items):
        groups[root(i)].append(key)
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(items))]


@pytest.mark.parametrize("dense", [2, 10_000])
def test_all_near_copies_are_found(spark, dense):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_groups(items)
    assert sum(k != g for (k, _), g in zip(items, want, strict=True)) > 10
    found = {r.doc_id: r.component_id for r in near_copies.near_groups(docs, dense=dense).collect()}
    assert found == {k: g for (k, _), g in zip(items, want, strict=True)}


def test_odd_rows(spark):
    found = by_id(near_copies.near_groups(documents(spark)))
    items = [(r[0], r[1]) for r in rows()]
    for (key, _), g in zip(items, brute_groups(items), strict=True):
        assert found[key][0].component_id == g
    assert sum(map(len, found.values())) == len(items)
    assert near_copies.near_groups(empty(spark)).count() == 0


def test_stage_drops_a_planted_near_copy(spark, sf_dir):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:100], "other", "words", *words[102:]]), " ".join(words[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == [0, 2]


def test_crowded_sets_around_the_threshold(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(70):
        words = list(base[: rng.choice([120, 135, 150])])
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = rng.choice(["x", f"own{k}"])
        texts.append(" ".join(words))
    items = list(enumerate(texts))
    docs = spark.createDataFrame(items, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_groups(docs, dense=3).collect()}
    assert found == dict(zip(range(70), brute_groups(items), strict=True))


def test_sets_with_a_frequent_part_and_a_part_of_their_own_do_not_meet(spark):
    rows = [(k, 100, 15, k, [7, 8, 9]) for k in range(40)] + [(50, 100, 5, 50, [7, 8, 9]), (51, 95, 2, 51, [7, 8, 9])]
    members = spark.createDataFrame([(t, at + i, node, n, root) for node, n, at, root, ts in rows for i, t in enumerate(ts)], "token long, at int, node long, n long, root long")
    links = object.__new__(near_copies.Links)
    assert {(r.a, r.b) for r in links._close(members).collect()} == {(50, 51)}


def test_counters_count_all_texts(spark):
    n = 30_000
    docs = spark.range(n).select(F.concat(F.lit("the same first words of all "), F.col("id").cast("string")).alias("_text"))
    counts = near_copies._counters(docs)
    held = int(near_copies.shingle_set("the same first words of")[0] % near_copies.COUNTERS)
    assert counts[held] == n
    assert counts.sum() == sum(len(set((near_copies.shingle_set(r._text) % near_copies.COUNTERS).tolist())) for r in docs.collect())
    assert not near_copies._counters(docs.limit(0)).any()


def test_small_tables_stay_in_one_partition(spark):
    held = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(held, "false")
    try:
        sets = spark.createDataFrame([(k, 10, [k % 5, 100 + k]) for k in range(40)], "node long, n long, tokens array<long>").repartition(8)
        links = object.__new__(near_copies.Links)
        links.roots = None
        found = links._several(sets)
        assert found.rdd.getNumPartitions() == 1
        assert found.count() == 40 and {r.held for r in found.collect()} == {8}
        assert len(links._star(found, 1).collect()) == 35
    finally:
        spark.conf.unset(held)


def test_lists_are_gathered_by_their_numbers(spark, monkeypatch):
    monkeypatch.setattr(common, "NUMBERS_A_TASK", 100)
    df = spark.range(50).select(F.array_repeat("id", 10).alias("v")).repartition(20)
    assert common.gathered(df, F.size("v")).rdd.getNumPartitions() == 5
    assert common.gathered(df).rdd.getNumPartitions() == 1
    assert common.gathered(df.limit(0), F.size("v")).count() == 0
