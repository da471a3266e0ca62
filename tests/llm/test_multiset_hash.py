"""Fingerprints and likenesses against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import multiset_hash

from .cases import documents, rows


def shingles(text):
    out = Counter()
    for line in (text or "").split("\n"):
        if line:
            words = re.split("[ \t\n\x0b\f\r]+", line)
            out.update([tuple(words)] if len(words) < 3 else [tuple(words[i : i + 3]) for i in range(len(words) - 2)])
    return out


def chained(words, seed=42):
    for w in words:
        seed = xxhash.xxh64_intdigest(w, seed)
    return seed


def fingerprint(text):
    exact, sums = [0] * multiset_hash.EXACT, Counter()
    for line in (text or "").split("\n"):
        if line:
            exact = [(x + chained([i.to_bytes(4, "little"), line.encode()])) % (1 << 32) for i, x in enumerate(exact)]
    for words, n in shingles(text).items():
        h = chained([w.encode() for w in words]) if len(words) == 3 else chained([" ".join(words).encode()])
        sums[h % (2 * multiset_hash.SKETCH) >> 1] += -n if h & 1 else n
    return "".join(f"{x:08x}" for x in exact) + "/" + ",".join(f"{k}:{v}" for k, v in sorted(sums.items()) if v)


def likeness(a, b):
    total = sum(v * v for v in a.values()) + sum(v * v for v in b.values())
    return 2 * sum(v * b[k] for k, v in a.items()) / total if total else 1.0


def edited(items):
    """``(id, text, edited text, next text)`` of each row, by descending id, nulls last."""
    order = sorted(items, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (key, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        yield key, text, text[: len(text) - half] + after[:half], after


@pytest.mark.parametrize("size", [2, 1000])
def test_all_columns_with_repeated_rows_and_null_ids(spark, monkeypatch, size):
    monkeypatch.setattr(multiset_hash, "RANGE_ROWS", size)
    items = [(r[0], r[1]) for r in rows()]
    want = Counter((k, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e)) for k, t, e, _ in edited(items))
    found = multiset_hash.edited(documents(spark)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in found) == want


def test_likeness_is_near_the_shingles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {r.doc_id: r for r in multiset_hash.edited(docs).collect()}
    apart = [(by[k].near_edited - likeness(shingles(t), shingles(e)), by[k].near_next - likeness(shingles(t), shingles(a))) for k, t, e, a in edited([(r.doc_id, r.text) for r in docs.collect()])]
    for errors in zip(*apart, strict=True):
        assert np.quantile(np.abs(errors), 0.9) < 0.05 and np.max(np.abs(errors)) < 0.2


def test_text_ids_and_many_rows_of_one_id(spark):
    items = [(f"k{i:03d}", f"text {i}\nand more of it {i % 7}") for i in range(40)] + [(None, f"none {i}") for i in range(30)] + [("k001", f"again {i}") for i in range(30)]
    docs = spark.createDataFrame(items, "doc_id string, text string")
    for size in (4, 1000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(multiset_hash, "RANGE_ROWS", size)
            got = multiset_hash.edited(docs).collect()
        assert Counter(r.doc_id for r in got) == Counter(k for k, _ in items)
        assert Counter(r.fingerprint for r in got) == Counter(fingerprint(t) for _, t in items)
        chars = {r.doc_id: r.edited_sha256 for r in got}
        for k, (key, text) in enumerate(items[39:2:-1]):
            after = items[38 - k][1]
            half = len(text) // 2
            assert chars[key] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_many_equal_shingles_do_not_wrap(spark):
    docs = spark.createDataFrame([(n, " ".join(["word"] * (n + 2))) for n in (70_000, 65_536, 35_000)] + [(0, "")], "doc_id long, text string")
    found = multiset_hash.fingerprints(docs)
    by = {r.doc_id: r for r in found.collect()}
    for n in (70_000, 65_536, 35_000):
        assert sorted(map(abs, by[n].sketch))[-2:] == [0, n] and len(by[n].exact) == 8 and len(by[n].sketch) == multiset_hash.SKETCH
    a, b = found.alias("a"), found.alias("b")
    near = {(r.i, r.j): r.near for r in a.crossJoin(b).select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), multiset_hash.likeness(F.col("a.sketch"), F.col("b.sketch")).alias("near")).collect()}
    assert near[70_000, 35_000] == pytest.approx(0.8) and near[65_536, 0] == 0 and near[70_000, 70_000] == 1
