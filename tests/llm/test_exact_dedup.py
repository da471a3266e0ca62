"""The extendible-hash index: its directory, chains, later batches and kinds of ids."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import exact_dedup
from tessera.llm.common import table_path

from .cases import SCHEMA, documents, empty, rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(items):
    """Each row's id, kept id, group size, whether it stays, and digest."""
    groups = defaultdict(list)
    for key, text in items:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), key is None, key if key is not None else "", key))
    out = Counter()
    for body, members in groups.items():
        keep = min(m[:3] + (0,) for m in members)
        keep = next(m[3] for m in members if m[:3] == keep[:3])
        for m in members:
            out[m[3], keep, len(members), m[3] == keep, hashlib.sha256(body.encode()).hexdigest()] += 1
    return out


def counted(df):
    return Counter((r[0], r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def looked_up(df):
    return Counter((r.id, r.keep_id if r.shared else r.id, r.group_size or 1) for r in df.collect())


def test_forced_collisions_are_chained_and_compared(spark):
    want = brute([(r[0], r[1]) for r in rows()])
    for hashed in (lambda b: F.length(b) % 3, lambda b: F.lit(7)):
        assert counted(exact_dedup.exact_groups(documents(spark), capacity=2, hashed=hashed)) == want
    path = exact_dedup.build_index(documents(spark), hashed=lambda b: F.lit(7))
    entries = exact_dedup.read_entries(spark, path).collect()
    assert {r.h for r in entries} == {7} and sorted(r.chain for r in entries) == list(range(len(entries)))
    assert len({r.body for r in entries}) == len(entries) and all(r.chained for r in entries)


def test_hot_copies_among_many_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 10)
    items = [(i, "the same text again" if i % 3 == 0 else f"text {i // 2}") for i in range(300)]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    assert counted(exact_dedup.exact_groups(docs, capacity=20)) == brute(items)


def test_rows_are_found_through_the_directory(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)], "doc_id long, text string")
    path = exact_dedup.build_index(docs, capacity=20)
    right = exact_dedup.read_directory(spark, path)
    assert right.count() == 1 << right.first().depth > 8 and exact_dedup.lookup(docs, path).filter("shared").count() == 400
    owned = exact_dedup.read_entries(spark, path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).orderBy("bucket").collect()
    assert all(r.n <= 20 for r in owned) and len(owned) > 8
    unsigned = [(r.low % (1 << 64), r.high % (1 << 64)) for r in owned]
    assert all(a[1] < b[0] for a, b in zip(unsigned, unsigned[1:], strict=False))
    # a directory whose slots name other buckets finds nothing
    last = right.agg(F.max("bucket")).first()[0]
    wrong = right.withColumn("bucket", F.when(F.col("bucket") == last, F.lit(owned[0].bucket)).otherwise(F.lit(last)))
    monkeypatch.setattr(exact_dedup, "read_directory", lambda *_: wrong)
    assert exact_dedup.lookup(docs, path).filter("shared").count() == 0


def test_later_batches_split_buckets(spark):
    items = [(i, f"text {i % 150}") for i in range(600)]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    path = table_path(spark, "batches")
    exact_dedup.insert(docs.filter("doc_id < 40"), path, capacity=16)
    first = exact_dedup.read_directory(spark, path).collect()
    exact_dedup.insert(docs.filter("doc_id = 40"), path, capacity=16)
    second = exact_dedup.read_directory(spark, path).collect()
    assert len({r.bucket for r in second if r.version == 1}) < len({r.bucket for r in second})  # others stay as written
    exact_dedup.insert(docs.filter("doc_id > 40"), path, capacity=16)
    third = exact_dedup.read_directory(spark, path).collect()
    assert third[0].depth > first[0].depth
    whole = exact_dedup.build_index(docs, capacity=16)
    assert looked_up(exact_dedup.lookup(docs, path)) == looked_up(exact_dedup.lookup(docs, whole))
    assert exact_dedup.read_entries(spark, path).count() == 150


def test_other_ids_and_no_rows(spark):
    items = [("b", "x y"), ("a", "xy"), (None, "x  y"), ("c", None), ("d", " "), ("e", "alone"), ("a", "xy")]
    docs = spark.createDataFrame(items, "doc_id string, text string")
    assert counted(exact_dedup.exact_groups(docs)) == brute(items)
    assert sorted(r.text or "" for r in exact_dedup.drop_exact(docs).collect()) == [" ", "alone", "x  y"]
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 and exact_dedup.drop_exact(empty(spark)).columns == SCHEMA_COLUMNS


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
