"""Packing token sequences by minimum bin slack.

A document's ids are cut at every full window; whole windows are sequences of their
own and what remains is one piece shorter than a window.  The pieces of a task are
held as counts by length.  A bin starts from the longest length left; a subset-sum
over bitsets (bit ``k`` set: ``k`` ids can be reached) finds which multiset of the
remaining lengths fills the rest most closely, stepping back through the bitsets
gives its counts, and the same filling is repeated as often as the counts allow.

Cuts, checksums and packing happen in the task that tokenises, so ids are never
shuffled and a window of pieces is bounded whatever the input's size.

Defined results: a null or empty text is a document of one id, the end id.  Repeated
rows are packed as rows.  Null ids stay null.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy
from .word_tokens import load, slices, with_end

#: Ids of a full sequence.
CAPACITY = 2048
#: The id that ends each document.
END_ID = 1
#: Pieces packed together in a task.
WINDOW_PIECES = 60_000
#: Bytes of text encoded together, and of a worker's memo of words: packing may follow stages whose executors are nearly full.
CHUNK_BYTES, MEMO_BYTES = 2_000_000, 64 << 20


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within *counts*, whose sum is nearest to *capacity* from below."""
    reach, steps, limit = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, many = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & limit
            left, many = left - take, many * 2
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] += take
            at -= length * take
    return dict(out)


def min_slack_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings as counts by length, each with the number of bins that use it; all *counts* are used up."""
    left = {k: n for k, n in counts.items() if n > 0}
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fill({k: n for k, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        times = min(left[k] // n for k, n in rest.items())
        yield rest, times
        for k, n in rest.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]


def pack_pieces(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """Bin and offset of each piece, and the number of bins."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        by[n].append(i)
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), 0
    for filling, times in min_slack_bins({n: len(x) for n, x in by.items()}, capacity):
        for _ in range(times):
            at = 0
            for n in sorted(filling, reverse=True):
                for _ in range(filling[n]):
                    i = by[n].pop()
                    bins[i], offsets[i] = used, at
                    at += n
            used += 1
    return bins, offsets, used


def packed_batches(batches: Iterator, id_column: str, tokenizer_path: str, capacity: int, end_id: int, ids: bool, base: int) -> Iterator:
    """A task's Arrow batches of ids and texts as batches of packed pieces; sequences are numbered from *base*."""
    import pyarrow as pa

    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids]
    tokens, width = load(tokenizer_path, MEMO_BYTES), 4 * capacity
    key_type, keys, parts = None, [], []
    # packed columns: start, length, crc32, tokens of the document
    columns = [array("q") for _ in range(4)]

    def flush():
        nonlocal base
        starts, lengths, crcs, totals = (np.frombuffer(c, np.int64) for c in columns)
        sequence, offset = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        short, whole = np.flatnonzero(lengths < capacity), np.flatnonzero(lengths == capacity)
        bins, offsets, used = pack_pieces(lengths[short].tolist(), capacity)
        sequence[short], offset[short] = np.array(bins, np.int64) + base, offsets
        sequence[whole] = base + used + np.arange(len(whole))
        base += used + len(whole)
        made = [pa.array(keys, key_type), *[pa.array(c.copy()) for c in (starts, lengths, crcs, totals)], pa.array(sequence), pa.array(offset), *[pa.array(parts, pa.binary())] * ids]
        return pa.RecordBatch.from_arrays(made, names)

    for batch in batches:
        key_type = batch.column(0).type
        texts = batch.column(1)
        for first, last in slices(texts, CHUNK_BYTES):
            flat, at = with_end(*tokens.encode_array(texts.slice(first, last - first)), end_id)
            packed, bounds = flat.astype("<u4").tobytes(), (at * 4).tolist()
            for key, a, b in zip(batch.column(0).slice(first, last - first).to_pylist(), bounds, bounds[1:], strict=False):
                for p in range(a, b, width):
                    part = packed[p : min(p + width, b)]
                    keys.append(key)
                    for c, v in zip(columns, ((p - a) // 4, len(part) // 4, zlib.crc32(part), (b - a) // 4), strict=True):
                        c.append(v)
                    if ids:
                        parts.append(part)
            del flat, at, packed
            if len(keys) >= WINDOW_PIECES:
                yield flush()
                keys, parts, columns = [], [], [array("q") for _ in range(4)]
        del batch, texts  # before the next one comes
    if keys:
        yield flush()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row a piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and ``ids`` if asked for.

    Sequence ids are the task's number in the high bits and the bin's in the low ones.
    """
    from pyspark import TaskContext

    kind = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("_id"), text_of(docs, text_column).alias("_text"))
    schema = f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids

    def run(batches):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield from packed_batches(batches, id_column, tokenizer_path, capacity, end_id, ids, task << 40)

    return frame.mapInArrow(tidy(run), schema)
