"""Phrases against brute force and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as c
from tessera.llm.queries import oracle_sql, queries

from .cases import SCHEMA, empty, rows

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(pairs, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in pairs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= 100}
        inner = set()
        for p, a in found.items():
            inner |= {q for m in range(2, len(p)) for s in range(len(p) - m + 1) if a >= found[q := p[s : s + m]]}
        listed = []
        for p, a in found.items():
            if p not in inner:
                cuts = [(1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                listed.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, n + 1, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(listed)[:top])}
    return out


def found(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def repeated():
    """Odd documents, many times over, with words that overlap themselves."""
    rng = random.Random(2)
    out = [r for r in rows() for _ in range(40)]
    for k in range(200):
        words = [rng.choice("Aé b c de\x0bf g".split(" ")) + rng.choice(["", "", ".", " ha ha ha ha"]) for _ in range(60)]
        out.append((k, " ".join(words) + "\tnew  York city; new york", rng.choice(["en", "und", None, "es"]), *[None] * 8))
    return out


def test_odd_documents(spark):
    docs = repeated()
    want = brute([(r[2], r[1]) for r in docs])
    assert len(want) > 100 and found(c.collocations(spark.createDataFrame(docs, SCHEMA).repartition(5))) == want
    assert c.collocations(empty(spark)).count() == 0


@pytest.mark.parametrize("shared,range_keys", [(True, 3000), (False, 3000), (False, c.RANGE_KEYS)])
def test_ranges_and_large_dictionaries(spark, monkeypatch, shared, range_keys):
    monkeypatch.setattr(c, "SEGMENT", 50)
    monkeypatch.setattr(c, "HELD_KEYS", 2000)
    docs = spark.createDataFrame(repeated(), SCHEMA).repartition(3)
    frame = c._frame(docs, "text", "lang")
    lexicon = c.numbered(c.count_words(frame).filter("n >= 100"), ["lang", F.desc("n"), "word"], "lexicon", "id").cache()
    words = {r.id: (r.lang, bytes(r.word).decode()) for r in lexicon.collect()}
    assert sorted(words) == list(range(1, len(words) + 1))
    got = {}
    for r in c.count_phrases(frame, lexicon, shared, len(words), frame.count() * 60, range_keys).collect():
        ids = np.frombuffer(bytes(r.key), ">u2").tolist()
        got[words[ids[0]][0], tuple(words[i][1] for i in ids)] = r.a
    f = Counter()
    for r in repeated():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            f.update((r[2] or "und", tuple(ws[i : i + k])) for k in range(2, 6) for i in range(len(ws) - k + 1))
    assert got == {k: a for k, a in f.items() if a >= 100}


def test_radix_order():
    rng = np.random.default_rng(1)
    for size in (10, 15):
        keys = rng.integers(0, 3, (5000, size)).astype(np.uint8)
        got, counts = c.radix_sorted(keys, np.arange(5000))
        want = Counter()
        for k, n in zip(keys, range(5000), strict=True):
            want[bytes(k)] += n
        assert [bytes(k) for k in got] == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]


def test_given_table_as_in_sql(spark):
    db = duckdb.connect()
    db.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = db.sql(f"select lang, rank, phrase, a, l, r, n, score from ({oracle_sql()['op13_collocations']})").fetchall()
    assert len(want) > 50 and found(queries()["op13_collocations"](spark, "/root/testdata/sf0.01")) == set(want)
