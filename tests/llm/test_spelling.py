"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from tessera.llm import spelling

from .cases import SCHEMA, documents, empty, rows

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_counts(pairs):
    n = Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                n[word] += 1
    return {w: c for w, c in n.items() if c >= 5}


def apart(a, b):
    """Whether two words differ by one code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(pairs):
    n = brute_counts(pairs)
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] is not None else None) for w in n}


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_odd_documents(spark):
    docs = [*rows() * 3, *[(k, "river stonés Stonés pebble " * 4, *[None] * 9) for k in range(4)]]
    want = brute([(r[0], r[1]) for r in docs])
    assert len(want) > 5 and found(spelling.variants(spark.createDataFrame(docs, SCHEMA))) == want
    assert spelling.variants(empty(spark)).count() == 0


def test_dense_words_chains_and_long_ones(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("aabé") for _ in range(rng.choice([6, 6, 7, 7, 8]))) for _ in range(250)}
    # a chain of forms, each five times as frequent, and a transposition
    chain = [("abcdef", 3000), ("abcdeg", 600), ("abcdhg", 120), ("abcihg", 24), ("bacdef", 9), ("abcdeff", 30)]
    long = ["xyz" * 700, "xyz" * 699 + "xy", "xyz" * 300 + "q" + "xyz" * 400, "x" * 3000, "x" * 3001]
    lines = [(1, " ".join([w] * n)) for w, n in [*((w, rng.choice([4, 5, 6, 30, 200])) for w in sorted(words)), *chain, *((w, 7) for w in long)]]
    got = found(spelling.variants(spark.createDataFrame(lines, "doc_id long, text string").repartition(4)))
    assert got == brute(lines)
    by = {r[0]: r for r in got}
    assert by["abcihg"][2] == "abcdef" and by["x" * 3000][4] == 1


def test_each_pair_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "abaaaa", "aabaaa", "baaaaa", "aaaaba"]
    table = spark.createDataFrame([(k, w, 5) for k, w in enumerate(words)], "id long, word string, n long")
    got = Counter((r.word, r.other) for r in spelling.near_words(table).collect())
    assert set(got) == {(a, b) for a in words for b in words if apart(a, b)} and set(got.values()) == {1}


def test_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 100 and found(spelling.variants(docs)) == want
    assert documents(spark).columns  # the fixture keeps its clashing names
