"""Scores recomputed from the model's rules, text by text."""

import math

import regex
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm import quality

from .cases import by_id, documents, rows

SPACE = "[ \t\n\x0b\f\r]"


def statistics(text):
    n = max(len(text), 1)
    words = [w for w in regex.split(SPACE + "+", text) if w]
    lines = [x for x in text.split("\n") if x]
    w = max(len(words), 1)
    count = lambda p: len(regex.findall(p, text))
    not_space = SPACE.replace("[", "[^")
    return {
        "log_chars": math.log1p(len(text)),
        "word_length": (n - count(SPACE)) / w,
        "distinct_words": len(set(words)) / w,
        "short_words": sum(len(x) < 4 for x in words) / w,
        "long_words": sum(len(x) > 15 for x in words) / w,
        "marks": count(r"[.,;:!?]") / n,
        "symbols": count(r"[^\p{L}\p{M}\p{N} " + "\t\n\x0b\f\r" + r".,;:!?'\"-]") / n,
        "upper": count(r"\p{Lu}") / n,
        "digits": count(r"\p{N}") / n,
        "capital_words": count(rf"(?<!{not_space})\p{{Lu}}") / w,
        "sentence_words": w / (1 + count(rf"[.!?](?!{not_space})")),
        "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "line_words": w / max(len(lines), 1),
    }


def brute_score(model, text):
    found = statistics(text or "")
    total = model.bias
    for rule, weight in model.rules:
        if all(found[name] <= x if low else found[name] > x for name, low, x in rule.tests):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_scores_follow_from_the_rules(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert len(model.rules) > 3
    for r in quality.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert abs(r.score - brute_score(model, r.text)) < 1e-9
    found = by_id(quality.score(documents(spark), model))
    for r in rows():
        assert any(abs(g.score - brute_score(model, r[1])) < 1e-9 and g.predicted == (g.score >= 0.5) for g in found[r[0]])


def test_the_sample_does_not_depend_on_layout(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.union(docs)
    one, other = quality.train(twice.repartition(2), labels, most=60), quality.train(twice.repartition(7, "lang"), labels.repartition(5), most=60)
    assert {r for r, _ in one.rules} == {r for r, _ in other.rules}


def test_all_labelled_rows_are_read(spark):
    """More rows of short lines that are good than the former bound, and of long lines that are not, by the largest hashes of their ids."""
    ids = spark.range(24_000).filter(~quality.held_out(F.col("id")))
    place = F.percent_rank().over(Window.orderBy(F.xxhash64("id"), "id"))
    rows = ids.select(F.col("id").alias("doc_id"), (place < 0.45).alias("early"))
    docs = rows.select("doc_id", F.when(F.col("early"), "one two three").otherwise("A line, of LONGER words: and 12345 marks.").alias("text"))
    labels = rows.select("doc_id", F.when(F.col("early"), 1).otherwise(0).alias("quality"))
    model = quality.train(docs.repartition(3), labels)
    other = quality.train(docs.repartition(7), labels.repartition(2))
    assert {r for r, _ in model.rules} == {r for r, _ in other.rules}
    good, bad = (quality.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).first().score for t in ("one two three", "A line, of LONGER words: and 12345 marks."))
    assert good > 0.9 and bad < 0.1


def test_a_fit_has_no_more_partitions_than_its_parts(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(quality, "PART_ROWS", 80)
    kind, seen = type(docs), []
    # a session may deal a key out to more partitions than it is asked for
    monkeypatch.setattr(kind, "repartition", lambda self, n, *cols, f=kind.repartition: f(self, max(n, 40) if cols else n, *cols))
    monkeypatch.setattr(quality, "fit", lambda sample, label, names: seen.append((sample.rdd.getNumPartitions(), sample.count())))
    quality.train(docs, labels)
    (parts, rows), = seen
    assert rows == labels.filter(~quality.held_out(F.col("doc_id"))).count()
    assert parts == -(-rows // 80)
