"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs: its lines, split at line feeds, without empty ones.  Each paragraph hashes to a wide vector,
and a document's fingerprint is the sum of its paragraphs' vectors, place by place,
modulo a power of two.  So the order of paragraphs does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector (:func:`combine`).

The vector has two parts.  ``EXACT`` places of 32 bits hash the paragraph as a whole and
tell documents apart.  ``SKETCH`` places of 32 bits hold the paragraph's word shingles: each adds +1 or
-1 to one place, by its hash.  The squared distance of two documents' places estimates how
many shingles they do not share, and squared norms how many they have, which gives the likeness::

    1 - |a - b|^2 / (|a|^2 + |b|^2), no less than 0

Its standard error is at most one in the root of ``SKETCH``, about 0.03.

Only DataFrame functions are used.  Texts are shuffled once, into ranges of neighbouring rows; what
follows stays in the range's task: sums by row and place, then by row, need no other exchange.

Defined results: a null text counts as empty; its sketch is zero, and two zero sketches have
likeness 1.  Repeated rows are documents of their own.  The next document goes by descending
id, nulls last, equal ids by the hash of their text and then by text; after the last comes the first, so a
lone document is its own next one.  Ids are of any type that has an order.  Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_table, text_of

EXACT = 8
SKETCH = 1024
#: Sums of fewer than 2^31 shingles do not wrap.
SKETCH_MOD = 1 << 32
_WORD = (1 << 32) - 1
SHINGLE = 3
#: Rows of a range of neighbouring ids, and most ranges; beyond that ranges get longer, and a task sorts its own with spilling.
RANGE_ROWS = 1000
MOST_RANGES = 1 << 16


def paragraphs(text: Column) -> Column:
    """The lines of a text that are not empty."""
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def exact_part(lines: Column) -> Column:
    """``EXACT`` sums of 32 bits over the hashes of the paragraphs."""

    def place(i: int) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda a, p: (a + F.xxhash64(F.lit(i), p)).bitwiseAND(F.lit(_WORD)))

    return F.array(*[_small(place(i), 1 << 32).cast("int") for i in range(EXACT)])


def shingle_hashes(words: Column) -> Column:
    """64-bit hashes of the shingles of a paragraph's *words*; of all of them together where there are fewer."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, many).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))


def places(lines: Column) -> Column:
    """For each shingle of the paragraphs twice its place, plus 1 where it counts -1."""
    words = F.transform(lines, lambda p: F.split(p, r"\s+"))  # a variable of its own, so that a line is split once
    per_line = F.transform(words, shingle_hashes)
    return F.transform(F.flatten(per_line), lambda h: h.bitwiseAND(F.lit(2 * SKETCH - 1)).cast("int"))


def _small(v: Column, mod: int) -> Column:
    """The number of least magnitude that is *v* modulo *mod*."""
    return F.pmod(v + mod // 2, F.lit(mod)) - mod // 2


def combine(a: Column, b: Column, mod: int, sign: int = 1) -> Column:
    """Sum (or, with *sign* -1, difference) of two vectors modulo *mod*: paragraphs inserted or deleted."""
    return F.zip_with(a, b, lambda x, y: _small(x.cast("long") + sign * y.cast("long"), mod))


def encoded(exact: Column, entries: Column) -> Column:
    """A fingerprint as text: the exact places in hexadecimal digits, and ``place:sum`` for each place of the sketch that is not 0."""
    digits = F.lower(F.array_join(F.transform(exact, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0")), ""))
    sketch = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["place"], F.lit(":"), e["v"])), ",")
    return F.concat(digits, F.lit("/"), sketch)


def from_sums(own: Column, other: Column, both: Column) -> Column:
    """Likeness from two sketches' squared norms and their inner product."""
    total = (own + other).cast("double")
    return F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 2 * both.cast("double") / total))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two sketches given as arrays, 0 to 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return from_sums(dot(a, a), dot(b, b), dot(a, b))


def _spot(key: Column, bounds: list) -> Column:
    """How many of the ascending *bounds* are at most *key*, by a coarse and a fine search."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    literal = lambda b: F.struct(F.lit(b[0]).alias("id"), F.lit(b[1]).alias("tie"))
    row = F.size(F.filter(F.array(*[literal(r[0]) for r in rows]), lambda b: b <= key))
    fine = F.array(*[F.array(*map(literal, r)) for r in rows])
    within = F.size(F.filter(F.element_at(fine, F.greatest(row, F.lit(1))), lambda b: b <= key))
    return F.when(row == 0, 0).otherwise((row - 1) * step + within)


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carried=lambda text: {}) -> DataFrame:
    """``spot``, ``k``, ``id``, ``text``, ``next_text`` of each row and the one after it by descending id, in ranges by ``spot``.

    Ids and text hashes alone are sorted first, which gives the ranges' bounds, a row a range.  Each range
    is then ordered on its own; the first row of every range is also sent to the range before it.
    *carried* names expressions over the text that go along, each also as ``next_`` of the row after.
    """
    text = text_of(docs, text_column)
    keyed = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    keys = keyed.select("id", "tie")
    ranges = max(1, min(MOST_RANGES, keys.count() // RANGE_ROWS))
    key = F.struct(F.col("id"), F.col("tie"))
    if ranges > 1:
        dealt = keys.repartitionByRange(ranges, "id", "tie").groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("low"))
        lows = sorted(((r.low.id, r.low.tie) for r in dealt.collect()), key=lambda b: (b[0] is not None, b[0] if b[0] is not None else 0, b[1]))
        # bounds without a null, so that literals have the ids' type; nulls are below all of them
        bounds = [b for b in lows if b[0] is not None][0 if lows and lows[0][0] is None else 1 :]
    else:
        bounds = []
    placed = keyed.withColumn("spot", _spot(key, bounds).cast("long"))
    spots = placed.groupBy("spot").agg(F.max(key).alias("head")).collect()  # a row a range
    full = sorted(r.spot for r in spots)
    above = {s: full[(k + 1) % len(full)] for k, s in enumerate(full)}
    heads = [(r.spot, r.head.id, r.head.tie, above[r.spot]) for r in spots]
    ends = small_table(docs.sparkSession, heads, f"spot long, head_id {docs.schema[id_column].dataType.simpleString()}, head_tie long, ahead long")
    # the head of each range goes before it too, and the very first one after the last
    marked = placed.join(F.broadcast(ends), "spot")  # a row a range
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    at = F.array(F.struct(F.col("spot").alias("spot"), F.lit(0).alias("ghost")))
    both = F.concat(at, F.array(F.struct(F.col("ahead").alias("spot"), F.lit(1).alias("ghost"))))
    parts = marked.select("id", "tie", "text", F.explode(F.when(is_head, both).otherwise(at)).alias("place")).select("id", "tie", "text", "place.spot", "place.ghost")
    order = Window.partitionBy("spot").orderBy("ghost", F.col("id").desc_nulls_last(), "tie", "text")
    dealt = parts.repartition(max(1, len(full)), "spot")
    more = carried(F.col("text"))
    dealt = dealt.withColumns(more) if more else dealt
    after = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *more)]
    ordered = dealt.select("spot", "ghost", "id", "text", *more, F.row_number().over(order).alias("k"), *after)
    return ordered.filter("ghost = 0").select("spot", "k", "id", "text", "next_text", *more, *[f"next_{c}" for c in more])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ``exact`` and ``sketch`` (``SKETCH`` sums) of each row."""
    text = text_of(docs, text_column)
    rows = docs.select(docs[id_column], F.monotonically_increasing_id().alias("_at"), paragraphs(text).alias("_lines"))
    rows = cut(rows.select(id_column, "_at", exact_part(F.col("_lines")).alias("exact"), places(F.col("_lines")).alias("_places")))
    spread = rows.select("_at", F.explode("_places").alias("p")).groupBy("_at", F.shiftright("p", 1).alias("place")).agg(F.sum(1 - 2 * F.col("p").bitwiseAND(F.lit(1))).alias("v"))
    filled = spread.groupBy("_at").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("_sums"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_sums"), i), F.lit(0)))
    return rows.join(filled, "_at", "left").select(id_column, "exact", F.transform(sums, lambda v: _small(v, SKETCH_MOD).cast("int")).alias("sketch"))


def edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likenesses.

    The edited text has the last half of the code points replaced by the first as many of the next document.
    """
    rows = with_next(docs, id_column, text_column, lambda text: {"places": places(paragraphs(text))})
    half = F.floor(F.length("text") / 2).cast("int")
    new = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = rows.select("spot", "k", "id", F.length("text").cast("long").alias("n_chars"), paragraphs(F.col("text")).alias("lines"), new.alias("new"), "places", "next_places")
    both = both.withColumns({"new_lines": paragraphs(F.col("new")), "digest": F.unhex(F.sha2("new", 256))})
    own = ["id", "n_chars", "digest", "exact0", "exact1"]
    rows = both.select("spot", "k", "id", "n_chars", "digest", exact_part(F.col("lines")).alias("exact0"), exact_part(F.col("new_lines")).alias("exact1"), "places", places(F.col("new_lines")).alias("new_places"), "next_places")
    # three counters in one sum would carry into each other, so each has its own; a row without shingles keeps its place
    which = F.array(*[F.struct(F.lit(i).alias("which"), F.when((F.size(c) > 0) | F.lit(i > 0), F.col(c)).otherwise(F.array(F.lit(-1))).alias("p")) for i, c in enumerate(("places", "new_places", "next_places"))])
    each = rows.select("spot", "k", *own, F.explode(which).alias("w")).select("spot", "k", *own, "w.which", F.explode("w.p").alias("p"))
    one = F.when(F.col("p") < 0, 0).otherwise(1 - 2 * F.col("p").bitwiseAND(F.lit(1)))
    sums = each.groupBy("spot", "k", *own, F.shiftright("p", 1).alias("place")).agg(*[F.sum(F.when(F.col("which") == i, one).otherwise(0)).alias(f"v{i}") for i in range(3)])
    dot = lambda i, j: F.sum(F.col(f"v{i}").cast("double") * F.col(f"v{j}")).alias(f"s{i}{j}")
    entry = lambda i: F.collect_list(F.when(F.col(f"v{i}") != 0, F.struct("place", F.col(f"v{i}").alias("v")))).alias(f"e{i}")
    made = sums.groupBy("spot", "k", *own).agg(dot(0, 0), dot(1, 1), dot(2, 2), dot(0, 1), dot(0, 2), entry(0), entry(1))
    prints = [encoded(F.col("exact0"), F.col("e0")).alias("fingerprint"), encoded(F.col("exact1"), F.col("e1")).alias("edited_fingerprint")]
    near = [from_sums(F.col("s00"), F.col("s11"), F.col("s01")).alias("near_edited"), from_sums(F.col("s00"), F.col("s22"), F.col("s02")).alias("near_next")]
    return made.select(F.col("id").alias(id_column), "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), *prints, *near)
