"""Operators over the whole table against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, multiset_hash, pii, quality, simhash
from tessera.llm.components import components
from tessera.llm.queries import oracle_sql, queries

from .cases import SCHEMA, by_id, documents, empty, prose, rows
from .test_near_copies import brute_groups

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_groups(spark):
    found = exact_dedup.exact_groups(documents(spark), capacity=2).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[SPACE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    want = Counter()
    for body, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for m in members:
            key = None if m[1] else m[2]
            want[key, keep, len(members), key == keep, hashlib.sha256(body.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == want
    kept = exact_dedup.drop_exact(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {k[0] for k in want if k[3]}
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_directory_doubles_until_buckets_fit():
    depth, slots = exact_dedup.directory({0: 5, 1: 5, 9: 1}, capacity=5, max_depth=4)
    assert depth == 4 and len(slots) == 16 and slots[:2] == [0, 1] and len(set(slots[8:])) == 1
    assert exact_dedup.directory({3: 100}, capacity=5, max_depth=4)[0] == 4
    assert exact_dedup.directory({}, capacity=5, max_depth=4) == (0, [0])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 6), (7, 6)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_components_of_few_links_have_no_task_a_shuffle_partition(spark):
    before, context = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "x long, y long").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        context.setJobGroup("few links", "few links")
        assert {r.root for r in components(links).collect()} == {0}
        jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("few links")]
        stages = [context.statusTracker().getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
        assert sum(s.numCompletedTasks for s in stages if s) < 200  # about 2,000 with a shuffle in every step of a round
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_fingerprint(text):
    words = [w for w in SPACE.split(text.translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_near_groups(spark):
    found = by_id(simhash.near_groups(documents(spark)))
    assert sum(map(len, found.values())) == len(rows())
    prints = [brute_fingerprint(r[1] or "") for r in rows()]
    groups = defaultdict(list)
    for r, g in zip(rows(), brute_components(prints), strict=True):
        groups[g].append(r[0])
    for r, p, g in zip(rows(), prints, brute_components(prints), strict=True):
        got = found[r[0]][0]
        assert got.fingerprint == f"{p:016x}"
        assert got.component_id == min((x for x in groups[g] if x is not None), default=None)
    assert simhash.near_groups(empty(spark)).count() == 0
    assert simhash.drop_near(documents(spark)).columns == documents(spark).columns


@pytest.mark.parametrize("dense", [2, 10_000])
def test_links_keep_every_component(spark, dense):
    import random

    rng, prints = random.Random(5), set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense)
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    found = {r.node: r.root for r in components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for x, g in zip(signed, brute_components(prints), strict=True):
        want[g].add(x)
        got[found.get(x, x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_multiset_hash_is_homomorphic(spark):
    docs = spark.createDataFrame([(1, "one two three four\nfive six"), (2, "five six\none two three four"), (3, "one two three four"), (4, "five six"), (5, ""), (6, None)], "doc_id long, text string")
    found = {r.doc_id: (r.exact, r.sketch) for r in multiset_hash.fingerprints(docs).collect()}
    assert found[1] == found[2] and found[5] == found[6] == ([0] * multiset_hash.EXACT, [0] * multiset_hash.SKETCH) and found[3] != found[4]
    for place, mod in ((0, 1 << 32), (1, multiset_hash.SKETCH_MOD)):
        assert [(a + b - c) % mod for a, b, c in zip(found[3][place], found[4][place], found[1][place], strict=True)] == [0] * len(found[1][place])
    both = spark.createDataFrame([(found[1][1], found[4][1])], "a array<int>, b array<int>")
    assert both.select(multiset_hash.combine(F.col("a"), F.col("b"), multiset_hash.SKETCH_MOD, -1).alias("c")).first().c == found[3][1]


@pytest.mark.parametrize("ranges", [2, 2000])
def test_edited_texts(spark, monkeypatch, ranges):
    monkeypatch.setattr(multiset_hash, "RANGE_ROWS", ranges)
    unique = [r for k, r in enumerate(rows()) if r not in rows()[:k]]
    docs = spark.createDataFrame(unique, SCHEMA).repartition(3)
    order = sorted(unique, key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = by_id(multiset_hash.edited(docs))
    assert len(found) == len(unique)
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        got = found[r[0]][0]
        assert got.n_chars == len(text)
        assert got.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= got.near_edited <= 1 and 0 <= got.near_next <= 1
    same = defaultdict(set)
    for r in unique:
        same[r[1] or ""].add(found[r[0]][0].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert multiset_hash.edited(empty(spark)).count() == 0


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 200
    held = quality.score(docs, model).filter("held_out").join(labels, "doc_id")
    assert held.filter("predicted = quality").count() / held.count() > 0.97
    scored = quality.score(documents(spark), model)
    assert scored.count() == len(rows()) and scored.filter("score is null or score < 0 or score > 1").count() == 0
    kept = quality.keep_good(documents(spark), model)
    assert kept.columns == documents(spark).columns and kept.count() == scored.filter("predicted = 1").count()
    assert quality.score(empty(spark), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(documents(spark), none).collect()} == {0.5}
    one = quality.train(docs, labels.filter("quality = 1"))
    assert quality.score(docs, one).filter("score <= 0.9").count() == 0


def test_surrogates(spark):
    found = pii.replace(documents(spark), counts=True)
    assert found.columns == [*documents(spark).columns, "n_entities", "entity_kinds"]
    by = by_id(found)
    assert sum(map(len, by.values())) == len(rows())
    for r in rows():
        got = by[r[0]][0]
        if r[1] is None or "john.doe" not in r[1].lower():
            assert got.text == r[1] or "0123456789abcdef0123" in r[1] or "+1578" in r[1]
    first, second = ([x for k in by for x in by[k] if x.text and x.text.startswith(start)][0] for start in ("Mail", "again"))
    assert first.entity_kinds == "card,email,ip,name,phone,ssn" and second.n_entities == 2
    mail = re.search(r"Mail (\S+) or", first.text)[1]
    assert re.search(r"again (\S+) and (\S+);", second.text).groups()[0] == mail and re.fullmatch(r"[a-z]{4}\.[a-z]{3}@\w+\.example\.org", mail)
    cards = re.search(r"card (\d{16}) or (\d{4} \d{4} \d{4} \d{4}),", first.text).groups()
    assert cards[0] == cards[1].replace(" ", "") != "4111111111111111" and cards[0][0] == "4"
    assert sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(cards[0][::-1])) % 10 == 0
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4},", first.text) and "555-6437" not in first.text and "10.20.30.40" not in first.text
    woman, man = re.search(r"Mrs (\w+) \w+ met Mr\. (\w+) \w+\.", first.text).groups()
    assert woman in pii.GIVEN["latin", "f"] and man in pii.GIVEN["latin", "m"]
    assert "version 2.0.1 costs 1234" in second.text and not any("5785556437" in (x.text or "") for v in by.values() for x in v)
    assert pii.replace(empty(spark)).count() == 0
    other = by_id(pii.replace(documents(spark), key="another"))
    assert mail not in "".join(x.text or "" for v in other.values() for x in v)


def test_surrogates_stay_distinct(spark, monkeypatch):
    monkeypatch.setattr(pii, "_number", lambda digest, at: F.conv(F.substring(digest, (at % 3 + 1).cast("int"), F.lit(1)), 16, 10).cast("int") % 5)
    hosts = [f"10.20.{i // 200}.{i % 200 + 1}" for i in range(60)]
    docs = spark.createDataFrame([(i, f"host {h} and {hosts[0]}") for i, h in enumerate(hosts)], "doc_id long, text string")
    assert not pii.redraws(docs, "k").isEmpty()
    got = {r.doc_id: re.findall(r"\d+\.\d+\.\d+\.\d+", r.text) for r in pii.replace(docs, key="k").collect()}
    assert len({v[0] for v in got.values()}) == 60 and len({v[1] for v in got.values()}) == 1 and got[0][0] == got[5][1]
    assert not {v[0] for v in got.values()} & set(hosts)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "PII", "packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in seen[1].collect()} == good
    best = {}
    for r in seen[1].collect():
        body = SPACE.sub("", r.text)
        best[body] = min(best.get(body, (1, 0)), (-len(r.text), r.doc_id))
    assert {r.doc_id for r in seen[2].collect()} == {k for _, k in best.values()}
    left = sorted(seen[2].collect(), key=lambda r: r.doc_id)
    # five words and a similarity of 0.8, as the stage's rule says
    groups = brute_groups([(r.doc_id, r.text) for r in left])
    assert {r.doc_id for r in seen[3].collect()} == set(groups) and len(set(groups)) < len(left)
    assert {r.doc_id for r in seen[4].collect()} == {r.doc_id for r in seen[3].collect()}
    assert {r.doc_id for r in seen[5].collect()} == {r.doc_id for r in seen[4].collect()}
    assert corpus_pipeline.run(spark, sf).count() == seen[5].count()


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
    assert len(prose(3, 1)) > 0
