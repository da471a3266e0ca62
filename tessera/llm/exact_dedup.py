"""Exact deduplication over an extendible-hash index kept in shared files.

Texts are equal when they are the same after white space ``[\\x20\\x09-\\x0D]`` is deleted.

The index is a folder.  Its *directory* is a table of ``2**depth`` slots, the leading bits of a
64-bit hash, each naming a bucket, the owner that processes it and the version in which it was
written.  A bucket is a file folder of entries: hash, position in the chain of its hash, the
normalised text, and the row that stays for it.  Doubling: a bucket that holds more hashes than its capacity
is split by one more bit, until it fits or the depth is used up; copies of one text have one
hash, so a hot text never overfills a bucket.

:func:`insert` sends every row to the owner of its slot.  An owner has a range of buckets, so of
hashes; it brings rows with equal bytes together, chains different texts with one hash, and
writes its buckets' files.  Later batches rewrite the buckets that they meet or split, and the
directory; other buckets stay as they were written.  :func:`lookup` finds a row's slot, bucket and hash, and where
a chain has several texts it compares bytes.

Everything is DataFrame work.  Hashes alone are counted first, with partial sums in each task; a
hash that more than one row in ``HOT`` has (there are fewer than ``HOT`` of them) has its copies combined
before they travel, and is looked up in a broadcast table, so a text that a third of the rows
share is one row a task.

Defined results: a null text counts as empty, all empty texts are one group.  Ties (same length)
go to the smallest id.  A null id sorts last.  Repeated rows count as rows.  Ids are of any type that has an order.
An empty table gives an empty result.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_SPACE, cut, exists, small_table, table_path, text_of

#: Hashes a bucket may hold before it is split.
BUCKET_ENTRIES = 20_000
#: Bits of the deepest directory; bounds it to 262,144 slots.
MAX_DEPTH = 18
#: A hash is hot if more than one row in so many has it; so many hashes can be hot at most.
HOT = 10_000
#: Bytes of text that an owner gets, while there are enough buckets.
OWNER_BYTES = 16 << 20


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, ASCII_SPACE, "")


def prefix(h: Column, depth: int) -> Column:
    """The leading *depth* bits of a 64-bit hash as a number."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(counts: dict[int, int], capacity: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Global depth and the bucket of each slot, from entry counts by the leading *max_depth* bits.

    Starts from one bucket and splits what is overfull; a bucket's number is the
    first slot, at full depth, that it owns.
    """
    sums = [0]
    for slot in range(1 << max_depth):
        sums.append(sums[-1] + counts.get(slot, 0))
    leaves, todo, depth = [], [(0, 0)], 0
    while todo:
        start, local = todo.pop()
        end = start + (1 << (max_depth - local))
        if sums[end] - sums[start] > capacity and local < max_depth:
            todo += [(start, local + 1), (start + (1 << (max_depth - local - 1)), local + 1)]
        else:
            leaves.append((start, end))
            depth = max(depth, local)
    slots, width = [0] * (1 << depth), 1 << (max_depth - depth)
    for start, end in leaves:
        for slot in range(start // width, end // width):
            slots[slot] = start
    return depth, slots


def _deepest(hashes: int, capacity: int, most: int) -> int:
    """Depth at which slots are counted: three bits beyond an even spread, so that what reaches the driver goes with the buckets."""
    return min(most, max(0, math.ceil(math.log2(max(1, hashes / capacity)))) + 3)


def _owners(slots: list[int], depth: int, weights: dict[int, int]) -> tuple[dict[int, int], int]:
    """The owner of each bucket, and how many there are: contiguous buckets of about ``OWNER_BYTES`` together."""
    by: dict[int, int] = {}
    for slot, bucket in enumerate(slots):
        by[bucket] = by.get(bucket, 0) + weights.get(slot, 0)
    out, owner, held = {}, 0, 0
    for bucket in sorted(by):
        if held and held + by[bucket] > OWNER_BYTES:
            owner, held = owner + 1, 0
        out[bucket] = owner
        held += by[bucket]
    return out, owner + 1


def _rows(docs: DataFrame, id_column: str, text_column: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """``id``, ``size`` (code points of the text), ``body`` (the normalised text) and ``h``."""
    text = text_of(docs, text_column)
    return docs.select(docs[id_column].alias("id"), F.length(text).cast("long").alias("size"), normalised(text).alias("body")).withColumn("h", hashed(F.col("body")).cast("long"))


def _latest(spark: SparkSession, path: str) -> int:
    """The number of the newest version of the index at *path*, -1 without one."""
    version = -1
    while exists(spark, f"{path}/directory-{version + 1}/_SUCCESS"):
        version += 1
    return version


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """``slot``, ``bucket``, ``depth``, ``version``: at most ``2**MAX_DEPTH`` rows."""
    return spark.read.parquet(f"{path}/directory-{_latest(spark, path)}")


def read_entries(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """All entries of the index, with their ``bucket``, ids being of type *kind*; of each bucket, those of the version that the directory names."""
    live = read_directory(spark, path).select("bucket", "version").distinct()
    every = spark.read.schema(f"h long, chain int, chained boolean, body string, size long, id {kind}, n long, version int, bucket long").parquet(f"{path}/entries")
    return every.join(F.broadcast(live), ["bucket", "version"], "left_semi")  # bounded by the directory


def insert(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH, hashed: Callable[[Column], Column] = F.xxhash64) -> str:
    """Puts the rows into the index at *path*, which is made where there is none; returns *path*.

    The directory is written last, so an insertion that fails leaves the index as it was.
    """
    spark = docs.sparkSession
    version, kind = _latest(spark, path) + 1, docs.schema[id_column].dataType.simpleString()
    rows = _rows(docs, id_column, text_column, hashed)
    met = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("body")).alias("bytes")))
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(met.filter(F.col("n") * HOT > total).select("h"))  # fewer than HOT rows
    old = read_entries(spark, path, kind) if version else None
    hashes = met.select("h") if old is None else met.select("h").union(old.select("h")).distinct()
    deepest = _deepest(hashes.count(), capacity, max_depth)
    counts = {r.slot: r.n for r in hashes.groupBy(prefix(F.col("h"), deepest).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2**MAX_DEPTH rows
    depth, slots = directory(counts, capacity, deepest)
    width = 64 - deepest
    # a bucket's number does not depend on the depth at which slots were counted
    slots = [(b << width) - (1 << 63) for b in slots]
    single = F.when(F.col("n") * HOT > total, F.col("bytes")).otherwise(F.col("n") * F.col("bytes"))
    weights = {r.slot: r.bytes for r in met.groupBy(prefix(F.col("h"), depth).alias("slot")).agg(F.sum(single).alias("bytes")).collect()}  # a row a slot
    owner_of, owners = _owners(slots, depth, weights)

    before = {r.bucket: (r.depth, r.slots, r.version) for r in read_directory(spark, path).groupBy("bucket", "depth", "version").agg(F.count(F.lit(1)).alias("slots")).collect()} if version else {}
    spans: dict[int, int] = {}
    for b in slots:
        spans[b] = spans.get(b, 0) + 1
    entered = {slots[s] for s in weights}
    # buckets that get rows or come from a split are written anew
    stays = {b for b, n in spans.items() if b not in entered and b in before and before[b][1] << depth == n << before[b][0]}
    table = [(s, b, depth, before[b][2] if b in stays else version, owner_of[b]) for s, b in enumerate(slots)]
    at = small_table(spark, table, "slot long, bucket long, depth int, version int, owner int")

    fresh = F.broadcast(at.filter(F.col("version") == version).select("slot", "bucket", "owner"))  # bounded by the directory
    copies = rows.join(hot, "h").groupBy("h", "body", "size").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count(F.lit(1)).alias("n"))
    parts = rows.join(hot, "h", "left_anti").select("h", "body", "size", "id", F.lit(1).cast("long").alias("n")).union(copies.select("h", "body", "size", "first.id", "n"))
    if old is not None:
        parts = parts.union(old.select("h", "body", "size", "id", "n"))
    sent = parts.withColumn("slot", prefix(F.col("h"), depth)).join(fresh, "slot").drop("slot").repartitionById(owners, F.col("owner"))
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("none"), "id")).alias("best")
    texts = sent.groupBy("owner", "bucket", "h", "body").agg(best, F.sum("n").alias("n"))
    chain = Window.partitionBy("owner", "bucket", "h")
    entries = texts.select(
        "bucket", "h", (F.row_number().over(chain.orderBy("body")) - 1).alias("chain"), (F.count(F.lit(1)).over(chain) > 1).alias("chained"),
        "body", (-F.col("best.less")).alias("size"), F.col("best.id").alias("id"), "n",
    )
    entries.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/entries/version={version}")
    at.drop("owner").coalesce(1).write.parquet(f"{path}/directory-{version}")
    return path


def lookup(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Each row's ``id``, ``h``, ``digest`` (SHA-256 of the normalised text) and the ``keep_id`` and ``group_size`` of its entry.

    Rows go by slot, bucket and hash; only entries of two or more rows are looked up, other rows
    stand for themselves.
    """
    spark = docs.sparkSession
    at = read_directory(spark, path)
    depth = at.first().depth
    entries = read_entries(spark, path, docs.schema[id_column].dataType.simpleString()).filter("n > 1")
    held = entries.select("bucket", "h", "chained", F.when(F.col("chained"), F.col("body")).alias("own"), F.struct(F.col("id").alias("keep_id"), F.col("n").alias("group_size")).alias("entry"))
    total = entries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = ~F.col("chained") & (F.col("entry.group_size") * HOT > total)
    common = F.broadcast(held.filter(is_hot).select("bucket", "h", F.col("entry").alias("hot")))  # fewer than HOT rows
    chained = not entries.filter("chained").isEmpty()
    rows = _rows(docs, id_column, text_column, hashed)
    # texts travel only where chains have to be compared
    own = rows.select("id", "h", F.unhex(F.sha2("body", 256)).alias("digest"), *[F.col("body")] * chained)
    routed = own.withColumn("slot", prefix(F.col("h"), depth)).join(F.broadcast(at.select("slot", "bucket")), "slot").drop("slot")  # bounded by the directory
    found = routed.join(common, ["bucket", "h"], "left")
    # rows that are done are dealt out evenly
    done = F.col("hot").isNotNull()
    found = found.withColumn("_bucket", F.when(done, F.lit(None).cast("long")).otherwise(F.col("bucket"))).withColumn("_h", F.when(done, F.xxhash64("id", "digest")).otherwise(F.col("h")))
    rest = held.filter(~is_hot).select(F.col("bucket").alias("_bucket"), F.col("h").alias("_h"), "own", F.col("entry").alias("rest"))
    same = (found["_bucket"] == rest["_bucket"]) & (found["_h"] == rest["_h"])
    if chained:
        same = same & (rest["own"].isNull() | (rest["own"] == found["body"]))
    entry = F.coalesce("hot", "rest")
    return found.join(rest, same, "left").select("id", found["h"], "digest", entry["keep_id"].alias("keep_id"), entry["group_size"].alias("group_size"), entry.isNotNull().alias("shared"))


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = BUCKET_ENTRIES, hashed: Callable[[Column], Column] = F.xxhash64) -> str:
    """The path of a new index of the rows in the shared folder."""
    return insert(docs, table_path(docs.sparkSession, "exact-index"), id_column, text_column, capacity, hashed=hashed)


def _found(docs: DataFrame, id_column: str, text_column: str, capacity: int, hashed: Callable[[Column], Column]) -> DataFrame:
    found = lookup(docs, build_index(docs, id_column, text_column, capacity, hashed), id_column, text_column, hashed)
    keep = F.when(F.col("shared"), F.col("keep_id")).otherwise(F.col("id"))
    return found.select("id", "h", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = BUCKET_ENTRIES, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Each row's group: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The kept row is the longest original text, then the smallest id.
    """
    found = _found(docs, id_column, text_column, capacity, hashed)
    return found.select(F.col("id").alias(id_column), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with their own columns; an id and a normalised text name a row."""
    keep = _found(docs, id_column, text_column, BUCKET_ENTRIES, F.xxhash64).filter("kept").select(F.col("id").alias("_kept_id"), F.col("h").alias("_kept_h")).distinct()
    h = F.xxhash64(normalised(text_of(docs, text_column)))
    return docs.join(keep, docs[id_column].eqNullSafe(keep["_kept_id"]) & (h == keep["_kept_h"]), "left_semi")
