"""Spelling variants: words one code point apart, found by a symmetric-delete join.

Every word gives keys for itself and for each distinct word with one code point
deleted; words that share a key are joined and the exact distance is verified.
Keys are 128-bit polynomial hashes, so that a deletion costs constant time and a
key row has a fixed size, whatever the word's length; rows carry the word's number
and the run of equal characters that the deletion may come from.  Two words at
distance one share exactly one key:

* a word and itself less one code point meet at the shorter word's own key;
* words with one code point replaced meet where that place is deleted; there the
  two runs overlap.  Words whose runs do not overlap differ in two places.

The run test prunes pairs before the words themselves are fetched and verified.
The words of one key differ in one inserted code point, so a key has at most as
many as the alphabet times the length; no key grows with the corpus.

A word's form is its near word of the largest count, if that is ``RATIO`` times the
word's or more.  Counts grow by that factor along forms, so chains are as short
as a logarithm, and roots are found by joining roots to roots.

Defined results: null texts hold no words; a null id counts as an empty string in
the sampling hash; repeated rows count each.  Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, tidy, written

#: A run of letters in lower-cased UTF-8: A-Z, and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: One in so many runs of a document loses a code point.
DAMAGED = 199
#: Least code points and occurrences of a word.
LENGTH, COUNT = 6, 5
#: How much more frequent than a word its form has to be.
RATIO = 5
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Texts above so many bytes are read run by run instead of all at once.
LONG = 1 << 20
#: Odd multipliers of the two polynomial hashes, and of the mixing of code points.
_BASES, _MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word`` and ``n`` over all documents, for words of ``LENGTH`` code points and ``COUNT`` occurrences or more.

    Counts are added up in each task before the shuffle.
    """
    import pyarrow as pa

    frame = docs.select(F.coalesce(docs[id_column].cast("string"), F.lit("")).cast("binary").alias("i"), text_of(docs, text_column).cast("binary").alias("t"))

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py().lower()  # bytes: ASCII letters only
                start = zlib.crc32(i.as_py() + b":")
                found = Counter(RUN.findall(text) if len(text) < LONG else (m[0] for m in RUN.finditer(text)))
                for raw, n in found.items():
                    if len(raw) < LENGTH:
                        continue
                    word, h = raw.decode(), zlib.crc32(raw, start)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= LENGTH:
                        held[word] += n
            if len(held) >= HELD:
                yield from out(held)
                held.clear()
        yield from out(held)

    def out(held):
        words = list(held)
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])

    return frame.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= COUNT)


def delete_keys(words: DataFrame) -> DataFrame:
    """Keys of every word: ``k1``, ``k2``, ``id``, and the run ``low`` to ``high`` of the deleted place, -1 for the word itself.

    *words* has ``id`` and ``word``.
    """
    import pyarrow as pa

    def keys(codes):
        """For words of one length as rows of code points: keys, row, low and high."""
        import numpy as np

        with np.errstate(over="ignore"):
            count, size = codes.shape
            fresh = np.ones((count, size), bool)
            fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
            row, low = np.nonzero(fresh)
            after = np.append(low[1:], 0)
            high = np.where(np.append(row[1:], -1) == row, after - 1, size - 1)
            made = []
            for base, mix in zip(_BASES, _MIX, strict=True):
                power = np.full(size, base, np.uint64)
                power[0] = 1
                power = np.cumprod(power, dtype=np.uint64)
                spread = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(mix)
                terms = (spread ^ (spread >> np.uint64(29))) * power
                sums = np.cumsum(terms, axis=1, dtype=np.uint64)
                whole, less = sums[:, -1], np.uint64(pow(base, -1, 1 << 64))
                part = (sums - terms)[row, low] + (whole[row] - sums[row, low]) * less
                made.append(np.concatenate((whole + np.uint64(size * mix % (1 << 64)), part + np.uint64((size - 1) * mix % (1 << 64)))).view(np.int64))
            self_row, none = np.arange(count), np.full(count, -1)
            return made[0], made[1], np.concatenate((self_row, row)), np.concatenate((none, low)), np.concatenate((none, high))

    def run(batches):
        import numpy as np

        for batch in batches:
            ids, by = np.asarray(batch.column(0)), {}
            for k, w in enumerate(batch.column(1).to_pylist()):
                by.setdefault(len(w), []).append((k, w))
            for size, members in by.items():
                step = max(1, 500_000 // size)
                for at in range(0, len(members), step):
                    part = members[at : at + step]
                    codes = np.frombuffer("".join(w for _, w in part).encode("utf-32-le"), np.uint32).reshape(len(part), size)
                    k1, k2, row, low, high = keys(codes)
                    own = ids[[k for k, _ in part]][row]
                    yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(own), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["k1", "k2", "id", "low", "high"])

    return words.select("id", "word").mapInArrow(tidy(run), "k1 long, k2 long, id long, low int, high int")


def near_words(words: DataFrame) -> DataFrame:
    """Each pair of words at distance one once, in both orders: ``word``, ``n``, ``other``, ``other_n``.  *words* has ``id``, ``word``, ``n``."""
    keys = delete_keys(words)
    left, right = keys.select("k1", "k2", F.col("id").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah")), keys.select("k1", "k2", F.col("id").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"))
    # the word itself and a deletion, or two deletions at one place
    meets = (F.greatest("al", "bl") <= F.least("ah", "bh")) | (F.least("al", "bl") < 0)
    pairs = left.join(right, ["k1", "k2"]).filter((F.col("a") < F.col("b")) & meets).select("a", "b")
    first = words.select(F.col("id").alias("a"), F.col("word").alias("aw"), F.col("n").alias("an"))
    second = words.select(F.col("id").alias("b"), F.col("word").alias("bw"), F.col("n").alias("bn"))
    near = pairs.join(first, "a").join(second, "b").filter(F.levenshtein("aw", "bw", 1) == 1)
    ways = [F.struct(F.col(x).alias("word"), F.col(m).alias("n"), F.col(y).alias("other"), F.col(k).alias("other_n")) for x, m, y, k in (("aw", "an", "bw", "bn"), ("bw", "bn", "aw", "an"))]
    return near.select(F.explode(F.array(*ways)).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last form, for words that have a ``form``; each round doubles the steps taken."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        state = cut(state.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = written(count_words(docs, id_column, text_column).withColumn("id", F.monotonically_increasing_id()), "words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best"))
    base = words.select("word", "n").join(best, "word", "left")
    holds = -F.col("best.m") >= RATIO * F.col("n")
    formed = written(base.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.other")).alias("form"), F.when(holds, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
