"""Quality classifier: a sparse ensemble of rules over text statistics.

A random forest over statistics of whole texts proposes rules, each the conjunction
of the tests on a path from a root to a node.  An L1-penalised logistic regression
over the rules' truth values keeps few of them, and the kept rules with their
weights compile to one Spark column expression, so scoring is a projection.

Only the text enters a score.  Training reads every labelled row that is not held out:
statistics, not texts, are joined with the labels, and dealt by hash to parts of about
``PART_ROWS`` in a fixed order, so the trees do not depend on how data is laid out.

Defined results: a null text counts as empty and gets the score of its statistics,
all zero.  Where there are no labels to learn from, every score is 0.5; where all
have one class, the score is that class's smoothed share.  Null ids count as not held
out.  Repeated rows are scored each.  Columns besides id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Labelled rows of a part of the training table, about.
PART_ROWS = 5000
TREES = 16
DEPTH = 3
#: Weight of the L1 penalty.
PENALTY = 0.002
#: Folds by crc32 of the id; fold 1 is held out.
FOLDS = 3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as expressions over ``text`` and its ``words`` and ``lines`` columns."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.col("words"), F.col("lines")
    w = F.greatest(F.size(words), F.lit(1)).cast("double")

    def share(pattern: str, of: Column = n) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / of

    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_length": (n - share(r"\s", F.lit(1.0))) / w,
        "distinct_words": F.size(F.array_distinct(words)) / w,
        "short_words": F.size(F.filter(words, lambda x: F.length(x) < 4)) / w,
        "long_words": F.size(F.filter(words, lambda x: F.length(x) > 15)) / w,
        "marks": share(r"[.,;:!?]"),
        "symbols": share(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"-]"),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{N}"),
        "capital_words": share(r"(?<!\S)\p{Lu}", w),
        "sentence_words": w / (1 + F.regexp_count(text, F.lit(r"[.!?](?!\S)"))),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": w / F.greatest(F.size(lines), F.lit(1)),
    }


def with_statistics(docs: DataFrame, text_column: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The *keep* columns and one column for each statistic."""
    keep = keep or []
    names = [f"_keep{i}" for i in range(len(keep))]
    text = text_of(docs, text_column)
    base = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], text.alias("text"))
    parts = base.withColumns({"words": F.filter(F.split("text", r"\s+"), lambda x: x != ""), "lines": F.filter(F.split("text", "\n"), lambda x: x != "")})
    return parts.select(*names, *[c.alias(k) for k, c in statistics(F.col("text")).items()])


@dataclass(frozen=True)
class Rule:
    """Tests ``(statistic, is_at_most, threshold)`` that all have to hold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.tests:
            out = out & (F.col(name) <= threshold if at_most else F.col(name) > threshold)
        return out


@dataclass
class RuleEnsemble:
    """A bias and weighted rules."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """The score, 0 to 1, as an expression over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(tree, names: list[str]) -> set[Rule]:
    """Rules of all paths of a fitted tree."""
    found, todo = set(), [(tree._call_java("rootNode"), {})]
    while todo:
        node, limits = todo.pop()
        if limits:
            found.add(Rule(tuple(sorted((names[k], low, x) for (k, low), x in limits.items()))))
        if node.getClass().getSimpleName() == "InternalNode":
            k, x = node.split().featureIndex(), float(node.split().threshold())
            for low, child in ((True, node.leftChild()), (False, node.rightChild())):
                best = min if low else max
                todo.append((child, limits | {(k, low): best(x, limits.get((k, low), x))}))
    return found


def fit(sample: DataFrame, label: str, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 7) -> RuleEnsemble:
    """An ensemble from rows with the statistics *names* and a 0/1 *label*."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    rows = sample.select(F.col(label).cast("double").alias("label"), *names)
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n:
        return RuleEnsemble()
    prior = math.log((good + 1) / (n - good + 1))
    if good in (0, n):
        return RuleEnsemble(prior)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=48, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted({r for t in forest.trees for r in _paths(t, names)}, key=repr)
    # a byte a rule in the table
    truth = cut(rows.select("label", F.array(*[F.coalesce(r.column(), F.lit(False)) for r in rules]).alias("truth")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(truth.select("label", array_to_vector(F.col("truth").cast("array<double>")).alias("features")))
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w]
    return RuleEnsemble(float(lasso.intercept), kept)


def held_out(id_: Column) -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", most: int | None = None) -> RuleEnsemble:
    """Fits on the labelled rows that are not held out; on the *most* with the smallest hash of their id, if that is given."""
    known = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("double").alias("_label")).dropna().filter(~held_out(F.col("_id")))
    names = list(statistics(F.col("text")))
    open_docs = docs.filter(~held_out(F.col(id_column)))
    if most is None:
        found = with_statistics(open_docs, text_column, [F.col(id_column), F.xxhash64(text_of(docs, text_column))])
        # an id that is labelled twice in the same way counts once
        joined = found.join(known.distinct(), found["_keep0"] == known["_id"]).select("_label", "_id", F.col("_keep1").alias("_hash"), *names)
        rows = cut(joined)
        parts = max(1, math.ceil(rows.count() / PART_ROWS))
        ordered = cut(rows.repartition(parts, "_id").sortWithinPartitions(F.xxhash64("_id"), "_id", "_hash", "_label"))
        # a fit has hundreds of passes, with a task a partition each; a session may deal a key out to more partitions than it is asked for
        return fit(ordered.coalesce(parts) if ordered.rdd.getNumPartitions() > parts else ordered, "_label", names)
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(most)
    joined = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(F.broadcast(chosen), "_id")  # at most *most* rows
    # ids may repeat among the documents; the bound holds all the same, by an order that layout does not change
    joined = joined.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"), "_label").limit(2 * most)
    return fit(cut(with_statistics(joined, "_text", [F.col("_label")])), "_keep0", names)


def score(docs: DataFrame, model: RuleEnsemble, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` for each document."""
    rows = with_statistics(docs, text_column, [F.col(id_column)])
    scored = rows.select(F.col("_keep0").alias(id_column), held_out(F.col("_keep0")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleEnsemble, text_column: str = "text") -> DataFrame:
    """The rows that the model accepts, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = with_statistics(docs, text_column, [row])
    return rows.filter(model.score() >= 0.5).select("_keep0.*")
