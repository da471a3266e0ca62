"""Phrase collocations, from sorted fixed-width keys of encoded words.

Words are counted by language, and those with ``LEAST`` occurrences get numbers.
Any phrase that is frequent consists of such words, so pieces break at all others.
At every place the numbers of up to ``WORDS`` words are packed into one binary key,
most significant byte first, zero after a break; the phrases that start there are the
heads of that key, so one key a place counts phrases of all lengths.  A task sorts its keys
by radix and adds up equal ones; they go to key ranges in blocks, each range is sorted
by radix and its runs of equal heads are counted.  A run that may go on in a
neighbouring range is handed on whatever its length, and parts are added up.

Ranges are bounded by quantiles of a sample of keys; the sample only balances the
ranges.  A range holds about ``RANGE_KEYS`` keys of each language's mix; a phrase that is
a third of all rows is one key a task.

The dictionary is broadcast where it has at most ``SHARED_WORDS`` words and
``SHARED_BYTES`` bytes; a larger one is joined with the words of all texts, in
segments of ``SEGMENT`` words that overlap by what a phrase can reach over.

Scores are exact, in decimals of 38 digits.  Defined results: null texts are empty, a null
language is ``und``; repeated rows count each.  Only the text and language columns are read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, tidy, written

#: Most words of a phrase, and least occurrences.
WORDS, LEAST = 5, 100
#: Rows returned for a language.
TOP = 2000
#: Bounds of a broadcast dictionary.
SHARED_WORDS, SHARED_BYTES = 1_000_000, 32 << 20
#: Keys of a range, and keys that a task holds before it sorts and deals them out.
RANGE_KEYS, HELD_KEYS = 2_000_000, 1_000_000
#: Keys of the sample for each range, and the least share of documents that it is drawn from.
SAMPLE, SAMPLE_SHARE = 64, 0.01
#: Distinct words of all languages that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Bytes of a text that are split at once, and words of a segment.
PART, SEGMENT = 1 << 20, 4096

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Ends of pieces become one byte that no word holds.
_TABLE = bytes(0x2E if c in _ENDS else c for c in range(256))
_BREAK = b"."
_SPACE = re.compile(rb"[ \t.]")


def _words(text: bytes):
    """Lists of a text's words, with ``.`` where pieces end, part by part."""
    text, at = text.lower().translate(_TABLE), 0
    while at < len(text):
        cut = _SPACE.search(text, at + PART) if len(text) - at > PART else None
        stop = cut.start() if cut else len(text)
        yield text[at:stop].replace(_BREAK, b" . ").split()
        at = stop


def _frame(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_column].cast("string"), F.lit("und")).alias("lang"), text_of(docs, text_column).cast("binary").alias("text"))


def count_words(frame: DataFrame) -> DataFrame:
    """``lang``, ``word`` (binary) and ``n`` of all words; added up in each task before the shuffle."""
    import pyarrow as pa

    def out(held):
        for lang, counts in held.items():
            words = list(counts)
            for k in range(0, len(words), 50_000):
                part = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], ["lang", "word", "n"])

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = held.setdefault(lang, Counter())
                for words in _words(text.as_py()):
                    counts.update(words)
                del counts[_BREAK]
                if sum(map(len, held.values())) >= HELD_WORDS:
                    yield from out(held)
                    held.clear()
        yield from out(held)

    return frame.mapInArrow(tidy(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(df: DataFrame, by: list, name: str, column: str) -> DataFrame:
    """*df* sorted over all partitions and numbered from 1 without gaps, written as a table."""
    held = written(df.sort(*by).withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_m", 33)
    before, rows = 0, []
    for r in held.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row a partition
        rows.append((int(r.p), before))
        before += r["count"]
    offsets = held.sparkSession.createDataFrame(rows or [(0, 0)], "_p long, _before long")
    return held.join(F.broadcast(offsets), part == F.col("_p")).withColumn(column, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_p", "_before")


def _packed(ids, own: int, width: int):
    """Keys of the places below *own* that begin two words or more: the numbers of ``WORDS`` words, zero after a break."""
    import numpy as np

    padded = np.concatenate((ids, np.zeros(WORDS, np.int64)))
    starts = np.flatnonzero((padded[:own] != 0) & (padded[1 : own + 1] != 0))
    keys = np.zeros((len(starts), WORDS * width), np.uint8)
    going = np.ones(len(starts), bool)
    for j in range(WORDS):
        column = padded[starts + j]
        going &= column != 0
        column = np.where(going, column, 0).astype(">u8").view(np.uint8).reshape(-1, 8)
        keys[:, j * width : (j + 1) * width] = column[:, 8 - width :]
    return keys


def _changes(keys, upto: int):
    """Where a row's first *upto* bytes differ from the row before."""
    import numpy as np

    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:, :upto] != keys[:-1, :upto]).any(1)
    return np.flatnonzero(new)


def radix_sorted(keys, counts):
    """Distinct keys in order and their counts: stable passes over two bytes at a time, last ones first, then run lengths."""
    import numpy as np

    size = keys.shape[1]
    wide = keys if size % 2 == 0 else np.concatenate((np.zeros((len(keys), 1), np.uint8), keys), axis=1)
    digits = np.ascontiguousarray(wide).view(">u2").astype(np.uint16)
    order = np.arange(len(keys))
    for d in range(digits.shape[1] - 1, -1, -1):
        column = digits[:, d]
        if len(column) and (column != column[0]).any():
            order = order[np.argsort(column[order], kind="stable")]  # radix sort for 16 bits
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = _changes(keys, size)
    return keys[at], np.add.reduceat(counts, at)


def _encoded(frame: DataFrame, lexicon: DataFrame, shared: bool) -> tuple[DataFrame, object]:
    """A table to read and a function of its batches that gives (numbers of words, own places) arrays."""
    spark = frame.sparkSession
    if shared:
        table: dict[str, dict] = {}
        for r in lexicon.select("lang", "word", "id").toLocalIterator():
            table.setdefault(r.lang, {})[bytes(r.word)] = r.id
        everywhere = spark.sparkContext.broadcast(table)

        def arrays(batch):
            import numpy as np

            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                get = everywhere.value.get(lang, {}).get
                parts = [np.fromiter((get(w, 0) for w in words), np.int64, len(words)) for words in _words(text.as_py())]
                if parts:
                    yield np.concatenate(parts), sum(map(len, parts))

        return frame, arrays
    return _joined(frame, lexicon), _stored


def _stored(batch):
    import numpy as np

    for ids, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
        yield np.asarray(ids.values), own


def _joined(frame: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Segments of texts as ``ids``, numbers of words (0: a break), and ``own``, how many places are their own."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held, segment = [], 0
                for words in _words(text.as_py()):
                    held += words
                    while len(held) >= SEGMENT + WORDS:
                        yield rows(row, segment, lang, held[: SEGMENT + WORDS])
                        held, segment = held[SEGMENT:], segment + 1
                if held:
                    yield rows(row, segment, lang, held)

    def rows(row, segment, lang, words):
        n = len(words)
        return pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array([segment] * n, pa.int64()), pa.array([lang] * n), pa.array(range(n), pa.int32()), pa.array(words, pa.binary())], ["row", "segment", "lang", "at", "word"])

    texts = written(frame.select(F.monotonically_increasing_id().alias("row"), "lang", "text"), "texts")
    each = texts.mapInArrow(tidy(run), "row long, segment long, lang string, at int, word binary")
    known = each.join(lexicon.select("lang", "word", "id"), ["lang", "word"], "left").select("row", "segment", F.struct("at", F.coalesce("id", F.lit(0)).alias("id")).alias("x"))
    lists = known.groupBy("row", "segment").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["id"]).alias("ids"))
    return lists.select("ids", F.when(F.size("ids") == SEGMENT + WORDS, SEGMENT).otherwise(F.size("ids")).alias("own"))


def count_phrases(frame: DataFrame, lexicon: DataFrame, shared: bool, words: int, places: int, range_keys: int = RANGE_KEYS) -> DataFrame:
    """``key`` (the packed numbers) and ``a`` of all phrases of two words or more with ``LEAST`` occurrences.

    *words* is the lexicon's size, *places* the number of words of all texts.
    """
    import numpy as np
    import pyarrow as pa

    width = max(2, -(-int(words).bit_length() // 8))
    size, ranges = WORDS * width, -(-places // range_keys) or 1
    table, arrays = _encoded(frame, lexicon, shared)
    bounds = np.zeros(0, f"S{size}")
    if ranges > 1:
        share = min(1.0, max(SAMPLE_SHARE, 10 * SAMPLE / range_keys))
        step = max(1, int(share * places / (SAMPLE * ranges)))

        def sampled(batches):
            for batch in batches:
                keys = [k[step // 2 % len(k) :: step] for ids, own in arrays(batch) if len(k := _packed(ids, own, width))]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(k) for k in np.concatenate(keys)], pa.binary())], ["key"])

        drawn = numbered(table.sample(fraction=share, seed=1).mapInArrow(tidy(sampled), "key binary"), ["key"], "sample", "rank")
        every = max(1, drawn.count() // ranges)
        found = drawn.filter((F.col("rank") % every == 0)).select("key").distinct().orderBy("key").collect()  # a key a range
        bounds = np.array([bytes(r.key) for r in found], f"S{size}")

    def blocks(held):
        keys = np.concatenate(held)
        keys, counts = radix_sorted(keys, np.ones(len(keys), np.int64))
        cuts = [0, *np.searchsorted(np.ascontiguousarray(keys).view(f"S{size}").ravel(), bounds).tolist(), len(keys)]
        for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if s < e:
                # byte by byte: leading bytes of sorted keys are runs, which shuffle files compress
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([keys[s:e].T.tobytes()], pa.binary()), pa.array([counts[s:e].astype("<u4").tobytes()], pa.binary())], ["range", "keys", "counts"])

    def deal(batches):
        held, rows = [], 0
        for batch in batches:
            for ids, own in arrays(batch):
                for at in range(0, own, HELD_KEYS):
                    part = ids[at : at + HELD_KEYS + WORDS]
                    keys = _packed(part, min(own - at, HELD_KEYS), width)
                    held.append(keys)
                    rows += len(keys)
                    if rows >= HELD_KEYS:
                        yield from blocks(held)
                        held, rows = [], 0
        if rows:
            yield from blocks(held)

    def runs(group):
        parts = [np.frombuffer(k.as_buffer(), np.uint8).reshape(size, -1).T for k in group.column("keys")]
        keys, counts = radix_sorted(np.concatenate(parts), np.concatenate([np.frombuffer(c.as_buffer(), "<u4").astype(np.int64) for c in group.column("counts")]))
        out_keys, out_counts = [], []
        for k in range(2, WORDS + 1):
            at = _changes(keys, k * width)
            sums = np.add.reduceat(counts, at)
            edge = np.zeros(len(at), bool)
            edge[[0, -1]] = True  # may go on in a neighbouring range
            real = keys[at, (k - 1) * width : k * width].any(1) & ((sums >= LEAST) | edge)
            out_keys += [bytes(x) for x in keys[at[real], : k * width]]
            out_counts.append(sums[real])
        return pa.table([pa.array(out_keys, pa.binary()), pa.array(np.concatenate(out_counts))], ["key", "a"])

    dealt = table.mapInArrow(tidy(deal), "range int, keys binary, counts binary")
    parts = dealt.groupBy("range").applyInArrow(runs, "key binary, a long")
    return parts.groupBy("key").agg(F.sum("a").alias("a")).filter(F.col("a") >= LEAST)


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", top: int = TOP) -> DataFrame:
    """The first *top* phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    frame = _frame(docs, text_column, lang_column)
    counted = written(count_words(frame), "counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    lexicon = written(numbered(counted.filter(F.col("n") >= LEAST), ["lang", F.desc("n"), "word"], "sorted", "id"), "lexicon")
    held = lexicon.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    places = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    width = max(2, -(-int(held.words).bit_length() // 8))
    shared = held.words <= SHARED_WORDS and held.bytes <= SHARED_BYTES
    phrases = written(count_phrases(frame, lexicon, shared, held.words, places), "phrases")

    def piece(start: str, size: str):
        """The binary head of a number of words, from a word counted from 0."""
        return F.expr(f"substring(key, cast(({start}) * {width} + 1 as int), cast(({size}) * {width} as int))")

    size = (F.octet_length("key") / width).cast("int")
    number = F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))
    named = lexicon.select(number.alias("key"), "lang", "word", "n")
    known = phrases.union(named.select("key", "n"))
    # every cut of a phrase, with the counts of both parts
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumn("left", piece("0", "k")).withColumn("right", piece("k", f"octet_length(key) / {width} - k")).withColumn("first", piece("0", "1"))
    cuts = cuts.join(named.select(F.col("key").alias("first"), "lang"), "first").join(totals, "lang")
    cuts = cuts.join(known.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(known.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("down", wide("l") * wide("r"))
    lowest = F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("least")
    scored = cuts.groupBy("key", "lang", "a", "n").agg(lowest)
    # phrases inside a longer one with as many occurrences
    inner = phrases.filter(size > 2).withColumn("m", F.explode(F.sequence(F.lit(2), size - 1))).withColumn("s", F.explode(F.sequence(F.lit(0), size - F.col("m"))))
    longer = inner.select(piece("s", "m").alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, "key", "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).select("key", "lang", "a", "n", "least.*")
    order = [F.desc("score"), F.desc("a")]
    near_top = written(kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place"), "ranked")
    each = near_top.select("key", F.explode(F.sequence(F.lit(0), size - 1)).alias("at")).withColumn("word_key", piece("at", "1"))
    spelt = each.join(named.select(F.col("key").alias("word_key"), F.col("word").cast("string").alias("word")), "word_key")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase")))
    return near_top.join(spelt, "key").withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
