"""SimHash near-duplicates, with candidates from pigeonring filtering.

Fingerprints have 64 bits.  They are laid out as a ring of five segments.  If two
fingerprints differ in at most two bits, then the ring has a segment from which
every chain of consecutive segments stays within its proportional budget: after
``j`` segments at most ``floor(2 j / 5)`` differing bits, that is 0, 0, 1, 1, 2.  So
the first two segments (25 or 26 bits) agree, and fingerprints are compared only
with those that share such a pair of segments at the same place of the ring; the
rest of the chain prunes before the full Hamming check.

A bucket with more than ``DENSE`` fingerprints is not compared pairwise: each of its
members goes to the keys that differ from it in one bit or none outside the shared
segments.  Members of one key are at most two bits apart, and any two members at
most two bits apart share a key, so linking each to the key's least fingerprint
keeps every component, with rows in proportion to the bucket's size.

Defined results: null and wordless texts have fingerprint zero, linked like any
other; texts with fewer words than a shingle use the whole sequence.  Copies meet
in one fingerprint before anything else.  Null ids are kept and count as largest.
Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, tidy
from .components import components

WIDTH = 64
#: Bits of the ring's segments, from the highest bit down.
SEGMENTS = (13, 13, 13, 13, 12)
#: Most differing bits of a link.
DISTANCE = 2
#: Fingerprints a bucket may hold for pairwise comparison; denser ones go the linear way.
DENSE = 48
#: Words of a shingle in the fingerprint's contract.
SHINGLE = 3


def fingerprint_bytes(text: str, size: int) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: -size] + 1)).tolist()
    hashes = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at : at + 16384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """Id and ``fp``, the fingerprint as a signed 64-bit number.  No shuffle."""
    import pyarrow as pa

    kind = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("_id"), text_of(docs, text_column).alias("_text"))

    def run(batches):
        for batch in batches:
            found = [fingerprint_bytes(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x - (1 << 64) if x >> 63 else x for x in found], pa.int64())], ["id", "fp"])

    return frame.mapInArrow(tidy(run), f"id {kind}, fp long")


def _mask(start: int, chain: int) -> int:
    """The bits of *chain* consecutive segments of the ring from segment *start*, as a signed number."""
    mask = 0
    for j in range(chain):
        k = (start + j) % len(SEGMENTS)
        below = WIDTH - sum(SEGMENTS[: k + 1])
        mask |= ((1 << SEGMENTS[k]) - 1) << below
    return mask - (1 << 64) if mask >> 63 else mask


def _free_chain() -> int:
    """Segments at the head of a chain whose budget is zero."""
    return max(j for j in range(1, len(SEGMENTS)) if j * DISTANCE // len(SEGMENTS) == 0)


def _within(a: Column, b: Column, start: Column) -> Column:
    """Whether the chain from segment *start* keeps all its budgets."""
    apart = a.bitwiseXOR(b)
    tests = F.lit(False)
    for s in range(len(SEGMENTS)):
        chain = F.lit(True)
        for j in range(_free_chain() + 1, len(SEGMENTS) + 1):
            chain = chain & (F.bit_count(apart.bitwiseAND(F.lit(_mask(s, j)))) <= j * DISTANCE // len(SEGMENTS))
        tests = tests | ((start == s) & chain)
    return tests


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all fingerprint pairs at most two bits apart.

    *fps* has the distinct fingerprints in column ``fp``.
    """
    head = _free_chain()
    ring = F.array(*[F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_mask(s, head))).alias("head")) for s in range(len(SEGMENTS))])
    keys = fps.select("fp", F.explode(ring).alias("k")).select("fp", F.col("k.start").alias("start"), F.col("k.head").alias("head"))
    held = keys.groupBy("start", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(keys.join(held, ["start", "head"]))
    sparse = shared.filter(F.col("n") <= dense).select("start", "head", "fp")
    other = sparse.select("start", "head", F.col("fp").alias("b"))
    pairs = sparse.withColumnRenamed("fp", "a").join(other, ["start", "head"]).filter(F.col("a") > F.col("b"))
    near = pairs.filter(_within(F.col("a"), F.col("b"), F.col("start"))).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    crowded = shared.filter(F.col("n") > dense)
    flips = None
    for s in range(len(SEGMENTS)):
        outside = ~_mask(s, head) & ((1 << 64) - 1)
        bits = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(WIDTH) if outside >> i & 1)]
        flips = F.when(F.col("start") == s, F.array(*[F.lit(b).cast("long") for b in bits])) if flips is None else flips.when(F.col("start") == s, F.array(*[F.lit(b).cast("long") for b in bits]))
    spread = crowded.select("start", "fp", F.explode(flips).alias("flip")).select("start", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp")
    least = spread.groupBy("start", "key").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = spread.join(least, ["start", "key"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return near.union(stars)


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """One row a document: id, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (the smallest id reachable)."""
    prints = cut(fingerprints(docs, id_column, text_column, size))
    fps = prints.groupBy("fp").agg(F.min("id").alias("least"))
    fps = cut(fps)
    roots = components(links(fps.select("fp"), dense)).withColumnRenamed("node", "fp")
    joined = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    label = cut(joined.join(named, "root").select("fp", "component_id"))
    out = prints.join(label, "fp")
    return out.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns."""
    groups = near_groups(docs, id_column, text_column, size)
    keep = groups.filter(F.col(id_column).eqNullSafe(F.col("component_id"))).select(F.col(id_column).alias("_kept_id")).distinct()
    return docs.join(keep, docs[id_column].eqNullSafe(keep["_kept_id"]), "left_semi")
