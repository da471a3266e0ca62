"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come in three steps, and a link is made only after a check of the whole sets:

1. SimHash: fingerprints over the shingles, linked by chains of ring segments (:mod:`.simhash`).
2. Minima: the least shingle by each of ``MINIMA`` orders; those that share one are compared with
   one of them.  With this, large groups of near copies are one component before step 3.
3. A prefix-filtered set join, which loses nothing.  Shingles are put in one global order, seldom
   ones first.  Two sets of ``n`` shingles that are similar enough share one of the first
   ``n - ceil(0.8 n) + 1`` of each, so sets meet in buckets of these; a bucket with one component has
   nothing to compare.  Any order that is the same for all sets loses nothing; the one here goes by
   counts over all texts, in a table of fixed size.  Pairs are counted by the shingles that their
   prefixes share; with those, and all that is outside the prefix of the larger set, a pair has to reach
   what it needs.  Sets of buckets with more than ``DENSE`` go by an order of their own, by how many of
   them hold a shingle, and meet in buckets of size bands: a set with ``o`` shingles from the shared one on
   meets only smaller sets that are similar enough if they share all these, and those only where they have
   as many left.  So sets that share a frequent part and have the rest to themselves do not meet at all.
   Buckets that are still crowded are first compared with one of their members in ``ROUNDS`` rounds,
   another one each time, and only pairs that are still in different components are compared after that,
   where bitmaps of a fixed length, which go along, let them be similar.

SimHash alone does not find them: texts at 0.8 differ in up to 17 of 64 bits, and chains of a ring
with that budget agree in three bits only at their head.

The check has two parts.  A bitmap of each set, about four bits a shingle, bounds what two sets share:
a bit that only one of them has stands for a shingle of its own.  Pairs that could still be similar
are compared by their sets, which are made again from the texts, so that sets of all texts are never
written or shuffled.  *docs* is read once a step, so it should be a table.

Defined results: words are lower-cased in ASCII and split at ASCII white space; a text with
fewer words than a shingle has its whole sequence as one; texts without words are near copies
of each other.  Null ids are kept and count as largest.  Only the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, dealt, gathered, text_of, tidy, written
from .components import components

SHINGLE = 5
#: Least Jaccard similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Orders whose minima are compared first.
MINIMA = 4
#: Sets a bucket may hold for pairwise comparison at once, and rounds for larger ones.
DENSE = 48
ROUNDS = 3
#: Ratio of sizes within a band.
BAND = 1.02
#: Words of 64 bits of the bitmap that crowded buckets compare as they meet.
SIGN = 16
#: Counters of shingles, and parts in which they are added up.
COUNTERS = 1 << 19
COUNTER_PARTS = 64
#: Rows of 64-bit keys that are sent to all tasks; more are joined by a shuffle.
SENT_KEYS = 1_000_000
#: Texts whose sets a task holds at once.
ROWS_AT_ONCE = 1000
_ALL = (1 << 64) - 1


def shingle_set(text: str):
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # ASCII letters and ASCII white space only
    return np.unique(np.array([xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), 7) for i in range(max(1, len(words) - SHINGLE + 1))] if words else [], np.uint64))


def needed(n: int) -> int:
    """Shingles that a set of *n* shares with any similar one, at least."""
    return -(-SIMILAR[0] * n // SIMILAR[1])


def similar(a, b) -> bool:
    """Whether two sorted sets are near copies."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def _counters(frame: DataFrame):
    """How many of all texts hold a shingle of each counter; a number a counter reaches the driver."""
    import numpy as np
    import pyarrow as pa

    schema, width = "part int, held binary", COUNTERS // COUNTER_PARTS

    def packed(parts, held):
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([h.astype("<i8").tobytes() for h in held], pa.binary())], ["part", "held"])

    def run(batches):
        found = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                found[np.unique(shingle_set(t.as_py()) % np.uint64(COUNTERS))] += 1
        if found.any():
            yield packed(range(COUNTER_PARTS), found.reshape(COUNTER_PARTS, width))

    def added(table):
        total = np.zeros(width, np.int64)
        for held in table.column("held"):
            total += np.frombuffer(held.as_buffer(), "<i8")
        return pa.Table.from_batches([packed([table.column("part")[0].as_py()], [total])])

    counts = np.zeros(COUNTERS, np.int64)
    for r in frame.select("_text").mapInArrow(tidy(run), schema).groupBy("part").applyInArrow(added, schema).collect():
        counts[r.part * width : (r.part + 1) * width] = np.frombuffer(r.held, "<i8")
    return counts


def bitmap(found) -> bytes:
    """Bits of a sorted set by the leading bits of its hashes; a power of two of them, about four a shingle."""
    import numpy as np

    width = max(6, (4 * len(found)).bit_length())
    bits = np.zeros(1 << width, bool)
    bits[(found >> np.uint64(64 - width)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_be_similar(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether sets of *n* and *m* shingles with these bitmaps can be near copies."""
    import numpy as np

    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)).view(bool) for v in (a, b))
    while len(x) > len(y):
        x = x.reshape(-1, 2).any(1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).any(1)
    both = min(n - int((x & ~y).sum()), m - int((y & ~x).sum()))
    return both * SIMILAR[1] >= SIMILAR[0] * (n + m - both)


def fingerprint(found) -> int:
    """SimHash of a set's hashes, as a signed number."""
    import numpy as np

    ones = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True)


def minima(found) -> list[int]:
    """The least shingle by each of ``MINIMA`` orders."""
    import numpy as np

    factors = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & _ALL) for k in range(MINIMA)]
    return [int((found * f).min().view(np.int64)) for f in factors] if len(found) else []


def sliced(batches):
    """Parts of batches, of few rows."""
    for batch in batches:
        for k in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def shingle_sets(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A row a text: ``row`` (its number), ``id``, ``text_hash``, ``key`` of its set, size ``n``, ``bits``, ``fp``, ``minima`` and ``prefix``.  No shuffle of texts."""
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    frame = docs.select(F.col(id_column).alias("_id"), text_of(docs, text_column).alias("_text"))
    counts = frame.sparkSession.sparkContext.broadcast(_counters(frame))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches):
            rows, firsts = [], []
            for t in batch.column(1):
                found = shingle_set(t.as_py())
                order = np.lexsort((found, counts.value[found % np.uint64(COUNTERS)]))
                key = xxh64_intdigest(found.tobytes(), 11)
                firsts.append(found[order[: len(found) - needed(len(found)) + 1]].view(np.int64))
                rows.append((key - (1 << 64) if key >> 63 else key, len(found), bitmap(found), fingerprint(found), minima(found)))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
            made = [pa.array(c, k) for c, k in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *made, prefix], ["id", "text_hash", "row", "key", "n", "bits", "fp", "minima", "prefix"])

    return frame.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()}).mapInArrow(tidy(run), f"id {kind}, text_hash long, row long, key long, n long, bits binary, fp long, minima array<long>, prefix array<long>")


def _near_sizes(a: str, b: str):
    """Whether the sizes of two sets allow them to be near copies."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def _few(keys: DataFrame) -> DataFrame:
    """Distinct keys, to be broadcast where a count shows that they are few."""
    return _sent(cut(keys.distinct()))


def _sent(rows: DataFrame) -> DataFrame:
    """A cut table, to be broadcast where a count shows that its rows are few."""
    return F.broadcast(rows) if rows.count() <= SENT_KEYS else rows


class Links:
    """Finds links between sets: *made* is a written table of :func:`shingle_sets` of *docs*.

    A set goes by the least number of the rows that have it.
    """

    def __init__(self, docs: DataFrame, made: DataFrame, text_column: str, dense: int = DENSE):
        self.dense = dense
        text = text_of(docs, text_column)
        self.texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))
        named = gathered(cut(made.groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("held"))))
        self.named = named.drop("held")
        copies = made.select("row", "key").join(_sent(named.filter("held > 1").select("key", "node")), "key").filter("row <> node").select("row")
        self.sets = made.join(_sent(gathered(cut(copies))), "row", "left_anti").withColumnRenamed("row", "node")
        self.roots: DataFrame | None = None

    def _texts_of(self, nodes: DataFrame) -> DataFrame:
        """``node`` and ``items``, the whole set as bytes, made from the texts."""
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        own = cut(self.sets.select("node", "key", "text_hash").join(_few(nodes), "node", "left_semi"))
        if own.count() <= SENT_KEYS:
            own = F.broadcast(own)
        texts = self.texts.join(own, "text_hash").select("node", "key", "text")

        def run(batches):
            for batch in sliced(batches):
                packed = [shingle_set(t.as_py()).tobytes() for t in batch.column(2)]
                # another text with the same hash has another set
                same = pa.array([xxh64_intdigest(p, 11) == k.as_py() % (1 << 64) for p, k in zip(packed, batch.column(1), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "items"]).filter(same)

        return texts.mapInArrow(tidy(run), "node long, items binary").groupBy("node").agg(F.first("items").alias("items"))

    def add(self, pairs: DataFrame) -> bool:
        """Adds those pairs ``a``, ``b`` of nodes whose sets are near copies; whether there were any."""
        import numpy as np
        import pyarrow as pa

        pairs = gathered(cut(pairs.filter("a <> b").distinct()))
        if pairs.isEmpty():
            return False
        bits = self.sets.select("node", "n", "bits").join(_few(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "node", "left_semi")
        sides = _sent(pairs).join(bits.withColumnsRenamed({"node": "a", "bits": "x"}), "a").join(bits.withColumnsRenamed({"node": "b", "n": "m", "bits": "y"}), "b").filter(_near_sizes("n", "m"))

        def could(batches):
            for batch in sliced(batches):
                n, x, m, y = (batch.column(c).to_pylist() for c in ("n", "x", "m", "y"))
                keep = [may_be_similar(*v) for v in zip(x, n, y, m, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        near = gathered(cut(sides.mapInArrow(tidy(could), "a long, b long")))
        if near.isEmpty():
            return False
        sets = self._texts_of(near.select(F.explode(F.array("a", "b")).alias("node")))
        both = _sent(near).join(sets.withColumnsRenamed({"node": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "items": "y"}), "b").select("a", "b", "x", "y")

        def check(batches):
            for batch in sliced(batches):
                keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        more = gathered(cut(both.mapInArrow(tidy(check), "a long, b long")))
        if more.isEmpty():
            return False
        # stars stand for all links so far
        links = more if self.roots is None else more.union(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.roots = _sent(gathered(cut(components(gathered(links)))))
        return True

    def rooted(self, frame: DataFrame) -> DataFrame:
        """*frame* with the ``root`` of each ``node``, itself where it has no link."""
        if self.roots is None:
            return frame.withColumn("root", F.col("node"))
        return frame.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def _several(self, sets: DataFrame) -> DataFrame:
        """``token``, its place ``at``, ``node``, ``n``, ``root`` and ``held`` of the members of buckets with several components; *sets* has their ``tokens``."""
        rooted = self.rooted(sets)
        tokens = rooted.select("node", "root", F.posexplode("tokens").alias("at", "token"))
        several = tokens.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held")).filter("low < high").select("token", "held")
        met = gathered(cut(tokens.select("token", "at", "node").join(several, "token")))
        return gathered(cut(met.join(rooted.select("node", "n", "root"), "node")))

    def _star(self, left: DataFrame, salt: int) -> DataFrame:
        """Pairs of each member with one of its bucket."""
        centre = left.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), "node", "n", "root")).alias("c")).select("token", F.col("c.node").alias("node2"), F.col("c.n").alias("n2"), F.col("c.root").alias("root2"))
        star = left.join(centre, "token").filter("root <> root2").filter(_near_sizes("n", "n2"))
        return star.select(F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b"))

    def _pairs(self, members: DataFrame) -> DataFrame:
        other = members.select("token", *[F.col(c).alias(f"{c}2") for c in members.columns if c != "token"])
        return members.join(other, "token").filter("node > node2 and root <> root2").filter(_near_sizes("n", "n2"))

    def _close(self, members: DataFrame) -> DataFrame:
        """Pairs of members that could be near copies if the shingle they meet by is the first that they share."""
        top, bottom = SIMILAR
        band = lambda n: F.floor(F.log(n) / math.log(BAND))
        least = F.ceil(F.col("n") * top / bottom - 1e-9)
        # shared shingles are among the n - at from this one on
        most = F.least(F.col("n"), F.floor((F.col("n") - F.col("at")) * (top + bottom) / top + 1e-9) - F.col("n"))
        larger = members.withColumns({"least": least, "most": most}).filter("least <= most")
        carried = [c for c in members.columns if c in ("node", "n", "at", "root", "sign")]
        larger = larger.select("token", *carried, F.explode(F.sequence(band("least"), band("most"))).alias("band"))
        smaller = members.select("token", band("n").alias("band"), *[F.col(c).alias(f"{c}2") for c in carried])
        reach = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) * (top + bottom) >= (F.col("n") + F.col("n2")) * top
        if "sign" in members.columns:
            apart = lambda x, y: sum(F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(SIGN))
            reach = reach & (F.least(F.col("n") - apart("sign", "sign2"), F.col("n2") - apart("sign2", "sign")) * (top + bottom) >= (F.col("n") + F.col("n2")) * top)
        ordered = (F.col("n2") < F.col("n")) | (F.col("n2") == F.col("n")) & (F.col("node2") < F.col("node"))
        return larger.join(smaller, ["token", "band"]).filter((F.col("root") != F.col("root2")) & ordered & reach & _near_sizes("n", "n2")).select(F.col("node").alias("a"), F.col("node2").alias("b"))

    def run(self) -> None:
        """Finds links whose components are those of all pairs of near copies."""
        prints = gathered(cut(self.sets.select("fp", "node")))
        near = simhash.links(prints.select("fp").distinct())
        one = prints.groupBy("fp").agg(F.min("node").alias("node"))
        alike = prints.join(one.withColumnRenamed("node", "b"), "fp").select(F.col("node").alias("a"), "b")
        chained = near.join(one.withColumnsRenamed({"fp": "a", "node": "ka"}), "a").join(one.withColumnsRenamed({"fp": "b", "node": "kb"}), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
        orders = F.transform("minima", lambda v, i: F.xxhash64(i, v))
        alike = alike.union(chained).union(self._star(self._several(self.sets.select("node", "n", orders.alias("tokens"))), 0))
        self.add(alike)

        shared = self._several(self.sets.select("node", "n", F.col("prefix").alias("tokens")))
        # shingles of crowded buckets are not counted, so they are granted to the pair
        crowds = shared.groupBy("node").agg(F.count(F.when(F.col("held") > self.dense, 1)).alias("granted"))
        few = shared.filter(F.col("held") <= self.dense).select("token", "node", "n", "root").join(crowds, "node")
        met = self._pairs(few).groupBy("node", "node2", "n", "n2", "granted", "granted2").agg(F.count(F.lit(1)).alias("met"))
        top, bottom = SIMILAR
        outside = F.ceil(F.greatest("n", "n2") * top / bottom - 1e-9) - 1
        reach = met.filter((F.col("met") + F.least("granted", "granted2") + outside) * (top + bottom) >= (F.col("n") + F.col("n2")) * top)
        self.add(reach.select(F.col("node").alias("a"), F.col("node2").alias("b")))
        crowd = shared.filter(F.col("held") > self.dense)
        if crowd.isEmpty():
            return
        # sets that share what many others have go by an order of their own
        own = self._reordered(crowd.select("node").distinct())
        placed = lambda met, alone: dealt(cut(met.join(alone, "node").withColumn("at", F.col("at") + F.col("alone"))))
        shared = self._several(own)
        self.add(self._close(placed(shared.filter(F.col("held") <= self.dense), own.select("node", "alone"))))
        if shared.filter(F.col("held") > self.dense).isEmpty():
            return
        for k in range(1, ROUNDS + 1):
            if not self.add(self._star(self._several(own), k)):
                break
        self.add(self._close(placed(self._several(own).filter(F.col("held") > self.dense), own.select("node", "alone", "sign"))))

    def _reordered(self, nodes: DataFrame) -> DataFrame:
        """``node``, ``n`` and the prefix ``tokens`` of sets in the order of how many of these very sets hold a shingle; ``alone`` shingles that no other of them holds come before; ``sign`` is a bitmap of the whole set."""
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for batch in sliced(batches):
                found = [np.frombuffer(v.as_py(), np.int64) for v in batch.column(1)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                bits = np.zeros((len(found), SIGN * 64), bool)
                for row, v in zip(bits, found, strict=True):
                    row[(v.view(np.uint64) % np.uint64(SIGN * 64)).astype(np.int64)] = True
                words = np.packbits(bits, axis=1).view(np.int64).ravel()
                signs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, SIGN), pa.int32()), pa.array(words))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))), signs], ["node", "items", "sign"])

        sets = gathered(cut(self._texts_of(nodes).mapInArrow(tidy(run), "node long, items array<long>, sign array<long>")), F.size("items") + SIGN)
        each = sets.select("node", F.explode("items").alias("token"))
        counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
        # a shingle that one set has alone comes first and meets nothing; sets of such shingles only have no tokens
        ranked = each.join(counts, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("ranked"))
        ranked = ranked.join(sets.select("node", "sign", F.size("items").cast("long").alias("n")), "node").withColumn("alone", F.col("n") - F.size("ranked"))
        top, bottom = SIMILAR
        prefix = F.col("n") - F.ceil(F.col("n") * top / bottom - 1e-9) + 1 - F.col("alone")
        own = cut(ranked.select("node", "n", "alone", "sign", F.transform(F.slice("ranked", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")), lambda r: r["token"]).alias("tokens")))
        return gathered(own, F.size("tokens") + SIGN)


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", dense: int = DENSE) -> DataFrame:
    """One row a document: id, ``text_hash`` and ``component_id``, the smallest id reachable over near copies."""
    made = written(shingle_sets(docs, id_column, text_column), "shingle-sets")
    links = Links(docs, made, text_column, dense)
    links.run()
    joined = gathered(cut(links.rooted(links.named)))
    label = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    return made.select("id", "text_hash", "key").join(label, "key").select(F.col("id").alias(id_column), "text_hash", "component_id")


def drop_near(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns; an id and a text name a row."""
    groups = near_groups(docs, id_column, text_column)
    keep = groups.filter(F.col(id_column).eqNullSafe(F.col("component_id"))).select(F.col(id_column).alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    own = F.xxhash64(text_of(docs, text_column))
    return docs.join(keep, docs[id_column].eqNullSafe(keep["_kept_id"]) & (own == keep["_kept_hash"]), "left_semi")
