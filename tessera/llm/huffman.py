"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Writing: texts are tokenised once into a table of ids, 16 or 32 bits wide as the vocabulary needs; ids are
counted over the whole corpus and
get code lengths of at most ``LIMIT`` bits (package-merge); codes are canonical, so the lengths
alone describe them.  Each document is coded once, into a second table, before the shuffle, so codes and not ids travel,
and ranges of ids put the documents in order.  Both tables are outside the files' folder and are
deleted when what follows from them is written.  A block holds whole documents of about
``BLOCK_IDS`` ids, a bit offset for every ``STRIDE`` ids of a document, and how many ids its part
has before it; nothing outside a block but the code lengths is needed to decode it.

Reading: a table of ``2**LIMIT`` entries gives the id and length of the code that begins a bit
string.  All checkpoints of a block are decoded side by side, one id of each at a time.

The container is a Parquet table in a folder that driver and executors share, so it works on any
file system that Spark reads.  Tasks write whole files or none, so a lost executor costs a rerun.

Defined results: a null or empty text is a document of the end id alone.  Ties of ids are ordered
by their codes; null ids come first.  An empty table gives empty files and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table_path, text_of, tidy
from .word_tokens import load, slices, with_end

#: Longest code in bits; also the decoding table's width.
LIMIT = 20
#: Ids of a block, at least, but for the last of a part.
BLOCK_IDS = 1 << 18
#: Ids of a document between two checkpoints.
STRIDE = 256
END_ID = 1


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each symbol, 0 where it does not occur, by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate((leaves, packages))
        by = np.argsort(merged, kind="stable")
        levels.append(by < len(leaves))
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and symbol."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[s])
        if n:
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length of the code at the head of each string of *limit* bits."""
    symbols, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order])
    total = int(spans.sum())
    symbols[:total], bits[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, bits


def encode(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Codes of documents' joined ids, each document from a byte border on.

    Also the byte at which each document begins, with the end, and the bit offset of each id in its document.
    """
    bits = lengths[ids]
    ends = np.cumsum(bits)
    borders = np.concatenate(([0], ends[np.cumsum(sizes) - 1])) if len(sizes) else np.zeros(1, np.int64)
    firsts = np.concatenate(([0], np.cumsum((np.diff(borders) + 7) // 8)))
    inside = ends - bits - np.repeat(borders[:-1], sizes)
    at = inside + np.repeat(firsts[:-1] * 8, sizes)
    words = np.zeros(int(firsts[-1]) // 4 + 2, np.uint64)
    if len(ids):
        # a code lies in the 64 bits of two words; codes do not overlap, so sums are unions
        wide = codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        word = at >> 5
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[heads]] += np.add.reduceat(wide >> np.uint64(32), heads)
        words[word[heads] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), heads)
    return words.astype(">u4").tobytes()[: int(firsts[-1])], firsts, inside


def decode(payload: bytes, starts: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """Ids from the bit offsets *starts*, *sizes* of them from each, joined."""
    symbols, bits = table
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    steps = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((steps, len(starts)), np.uint32)
    at, last = starts.astype(np.int64), len(windows) - 1
    for k in range(steps):
        head = windows[np.minimum(at >> 3, last)] >> (32 - limit - (at & 7)).astype(np.uint32) & np.uint32((1 << limit) - 1)
        out[k] = symbols[head]
        at += bits[head]
    return out.T[np.arange(steps) < sizes[:, None]]


def symbols_of(tokenizer_path: str, end_id: int = END_ID) -> int:
    """One more than the largest id that documents can have."""
    from tokenizers import Tokenizer

    return 1 + max(end_id, *Tokenizer.from_file(tokenizer_path).get_vocab().values())


def id_type(symbols: int) -> str:
    """The type of an id in the table of ids."""
    if symbols > 1 << 32:
        raise ValueError(f"{symbols} ids do not fit in 32 bits")
    return "<u2" if symbols <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, tokenizer_path: str, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, wide: str = "<u2") -> DataFrame:
    """Writes ``id`` and ``ids`` (little-endian, of type *wide*) of each document to *path*."""
    import pyarrow as pa

    size = np.dtype(wide).itemsize
    kind = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("_id"), text_of(docs, text_column).alias("_text"))

    def run(batches):
        tokens = load(tokenizer_path)
        for batch in batches:
            for first, last in slices(batch.column(1)):
                n = last - first
                flat, at = with_end(*tokens.encode_array(batch.column(1).slice(first, n)), end_id)
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(flat.astype(wide))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), ids], ["id", "ids"])

    made = frame.mapInArrow(tidy(run), f"id {kind}, ids binary")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def joined(column, wide: str = "<u2") -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column in one array, and how many each row has."""
    size = np.dtype(wide).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // size
    ids = np.frombuffer((column.buffers()[2] or b"")[: int(offsets[-1]) * size], wide)
    return ids[offsets[0] :], np.diff(offsets)


def id_counts(tokens: DataFrame, vocabulary: int = 1 << 16, wide: str = "<u2") -> np.ndarray:
    """How often each id occurs in all documents; one row an id reaches the driver."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(joined(batch.column(0), wide)[0], minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["s", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():
        out[r.s] = r.n
    return out


def write_files(docs: DataFrame, tokenizer_path: str, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> None:
    """Writes the corpus to *path*: ``codes`` (the code lengths) and ``blocks``."""
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    symbols = symbols_of(tokenizer_path, end_id)
    wide, ids_at, coded_at = id_type(symbols), table_path(spark, "ids"), table_path(spark, "coded")
    tokens = token_table(docs, tokenizer_path, ids_at, id_column, text_column, end_id, wide)
    kind = tokens.schema["id"].dataType.simpleString()
    lengths = code_lengths(id_counts(tokens, symbols, wide))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in used], "symbol int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    codes = canonical_codes(lengths)

    def code(batches):
        for batch in batches:
            ids, sizes = joined(batch.column(1), wide)
            ends = np.cumsum(sizes)
            done = 0
            while done < len(sizes):
                # about a million ids together, whole documents
                last = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 20))))
                part, own = ids[ends[done] - sizes[done] : ends[last - 1]], sizes[done:last]
                payload, firsts, inside = encode(part, own, codes, lengths)
                begins = np.concatenate(([0], np.cumsum(own)))
                marks = [inside[a:b:STRIDE].tolist() for a, b in zip(begins, begins[1:], strict=False)]
                parts = [payload[a:b] for a, b in zip(firsts, firsts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, last - done), pa.array(own, pa.int64()), pa.array(parts, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], ["id", "n", "payload", "marks"])
                done = last

    def block(batches):
        part, before, number = TaskContext.get().partitionId(), 0, 0
        held, ids = [], 0

        def made():
            starts, at = [], 0
            for _, _, payload, marks in held:
                starts += [8 * at + m for m in marks]
                at += len(payload)
            columns = [[part], [number], [before], [[h[0] for h in held]], [[h[1] for h in held]], [starts], [b"".join(h[2] for h in held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        names = ["part", "block", "before", "doc_ids", "sizes", "starts", "payload"]
        for batch in batches:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(batch.column(0).type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                ids += row[1]
                if ids >= BLOCK_IDS:
                    yield made()
                    before, number, held, ids = before + ids, number + 1, [], 0
        if held:
            yield made()

    coded = tokens.mapInArrow(tidy(code), f"id {kind}, n long, payload binary, marks array<long>")
    coded.write.option("compression", "lz4").parquet(coded_at)
    discard(spark, ids_at)
    ordered = spark.read.schema(coded.schema).parquet(coded_at).repartitionByRange("id").sortWithinPartitions("id", "n", "payload")
    ordered.mapInArrow(block, f"part int, block int, before long, doc_ids array<{kind}>, sizes array<long>, starts array<long>, payload binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(spark, coded_at)


def read_files(spark: SparkSession, path: str, id_column: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row a document, decoded from the files: id, ``start``, ``n_tokens``, ``ids_crc32``, and ``ids`` if asked for."""
    import pyarrow as pa

    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    codes = spark.read.parquet(f"{path}/codes").collect()  # at most one row an id of the vocabulary
    lengths = np.zeros(1 + max((r.symbol for r in codes), default=0), np.int64)
    for r in codes:
        lengths[r.symbol] = r.bits
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()  # a row a part
    firsts, at = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        firsts[r.part], at = at, at + r.n

    def run(batches):
        table = decoding_table(lengths)
        names = [id_column, "start", "n_tokens", "ids_crc32", *["ids"] * ids]
        for batch in batches:
            for part, before, keys, sizes, starts, payload in zip(*[batch.column(c) for c in ("part", "before", "doc_ids", "sizes", "starts", "payload")], strict=True):
                sizes = np.array(sizes.as_py(), np.int64)
                lanes = [min(STRIDE, n - k) for n in sizes.tolist() for k in range(0, n, STRIDE)]
                found = decode(payload.as_py(), np.array(starts.as_py(), np.int64), np.array(lanes, np.int64), table).astype("<u4")
                begins = np.concatenate(([0], np.cumsum(sizes)))
                packed = [found[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)]
                first = firsts[part.as_py()] + before.as_py()
                columns = [keys.values, pa.array(first + begins[:-1]), pa.array(sizes), pa.array([zlib.crc32(p) for p in packed], pa.int64()), *[pa.array(packed, pa.binary())] * ids]
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.select("part", "before", "doc_ids", "sizes", "starts", "payload").mapInArrow(tidy(run), f"`{id_column}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def round_trip(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = table_path(docs.sparkSession, "token-ids")
    write_files(docs, tokenizer_path, path, id_column, text_column)
    return read_files(docs.sparkSession, path, id_column)
