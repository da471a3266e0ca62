"""Image files as arrays, and arrays as image files.

PNG, JPEG, BMP and GIF go through Spark's image source; PPM, PGM and HDR through its binary files, each with a
glob of its own names, so that no file is read twice.
Arrays are in BGR order, as elsewhere in the library.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.depths import TensorError
from ..operators.blocks import _numbers
from . import jpeg

UNCHANGED, GRAYSCALE, COLOR = -1, 0, 1
SCHEMA = "path string, h int, w int, cn int, data array<int>"


def _elements(frame: DataFrame, parse) -> DataFrame:
    """Dense arrays from files: *parse* gives (h, w, cn, bytes) or None, which leaves an empty array."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [parse(*(v.as_py() for v in row)) or (0, 0, 0, b"") for row in zip(*batch.columns[1:], strict=True)]
            ends = np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32)
            data = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(r[3] for r in rows), np.uint8).astype(np.int32)))
            sizes = [pa.array([r[k] for r in rows], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, data], ["path", "h", "w", "cn", "data"])

    return frame.mapInArrow(run, SCHEMA)


def parse_pnm(content: bytes) -> tuple[int, int, int, bytes] | None:
    """A binary PGM or PPM of up to 255 levels; PPM comes out as BGR."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(content) and (content[at : at + 1].isspace() or content[at : at + 1] == b"#"):
            at = content.find(b"\n", at) + 1 or len(content) if content[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        if end == at:
            return None
        fields.append(content[at:end])
        at = end
    if fields[0] not in (b"P5", b"P6") or not all(f.isdigit() for f in fields[1:]) or int(fields[3]) > 255:
        return None
    w, h, cn = int(fields[1]), int(fields[2]), 1 if fields[0] == b"P5" else 3
    body = content[at + 1 : at + 1 + w * h * cn]
    if len(body) != w * h * cn:
        return None
    if cn == 3:
        turned = bytearray(body)
        turned[0::3], turned[2::3] = body[2::3], body[0::3]
        body = bytes(turned)
    return h, w, cn, body


def parse_hdr(content: bytes) -> tuple[int, int, int, bytes] | None:
    """A Radiance picture, its range brought to 8U by a gamma of 2.2, as BGR."""
    head, gap, body = content.partition(b"\n\n")
    size, _, body = body.partition(b"\n")
    fields = size.split()
    if not gap or not head.startswith((b"#?RADIANCE", b"#?RGBE")) or len(fields) != 4 or fields[0] != b"-Y" or fields[2] != b"+X" or not (fields[1].isdigit() and fields[3].isdigit()):
        return None
    h, w = int(fields[1]), int(fields[3])
    # a row has two bytes a channel for every 127 places at least, and its mark
    if h == 0 or w == 0 or h * (4 + 8 * -(-w // 127)) > len(body) and h * w * 4 > len(body):
        return None
    rows, at = np.zeros((h, 4, w), np.uint8), 0
    if not (8 <= w < 32768 and body[:2] == b"\x02\x02"):
        if len(body) < h * w * 4:
            return None
        rows = np.frombuffer(body, np.uint8, h * w * 4).reshape(h, w, 4).transpose(0, 2, 1)
    else:
        for y in range(h):
            at += 4  # the mark of a row and its width
            for k in range(4):
                x = 0
                while x < w:
                    if at + 1 >= len(body):
                        return None
                    n = body[at]
                    run = n - 128 if n > 128 else n
                    part = bytes([body[at + 1]]) * run if n > 128 else body[at + 1 : at + 1 + n]
                    if not run or x + run > w or len(part) < run:
                        return None
                    rows[y, k, x : x + run] = np.frombuffer(part, np.uint8)
                    at += 2 if n > 128 else 1 + n
                    x += run
    light = rows[:, :3].astype(np.float64) * np.where(rows[:, 3:] > 0, np.exp2(rows[:, 3:].astype(np.float64) - 136), 0.0)
    seen = np.clip(np.floor(np.power(light, 1 / 2.2) * 255 + 0.5), 0, 255).astype(np.uint8)
    return h, w, 3, np.ascontiguousarray(seen.transpose(0, 2, 1)[..., ::-1]).tobytes()


#: Ends of names of files that are parsed here, and of those that Spark's image source reads.
PARSED, DECODED = ("ppm", "pgm", "pnm", "hdr"), ("png", "jpg", "jpeg", "bmp", "gif", "wbmp", "tif", "tiff")
#: Files of other names that are asked for by path; if there are more, all files are read once more.
OTHERS = 10_000


def parse(content: bytes) -> tuple[int, int, int, bytes] | None:
    """A picture of a format that its leading bytes tell."""
    return parse_hdr(content) if content.startswith(b"#?") else parse_pnm(content)


def _ends(names: tuple[str, ...]) -> str:
    """A glob of file names with one of these ends, in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in n) for n in names) + "}"


def imread(spark: SparkSession, path: str, flags: int = COLOR) -> DataFrame:
    """Dense 8U arrays of the files under *path*; a file that is no image gives an empty array and no failure.

    Each file's content is read once, by the reader that its name tells; other names are listed first and go through Spark's image source.
    """
    if flags not in (UNCHANGED, GRAYSCALE, COLOR):
        raise TensorError(f"unknown flag {flags}")
    pictures = lambda source: _elements(source.select("image.*").select("origin", "height", "width", "nChannels", "data"), lambda h, w, cn, data: (h, w, cn, bytes(data)) if h and h > 0 else None)
    reader = lambda kind: spark.read.format(kind).option("dropInvalid", "false")
    decoded = pictures(reader("image").option("pathGlobFilter", _ends(DECODED)).load(path))
    decoded = decoded.unionByName(_elements(reader("binaryFile").option("pathGlobFilter", _ends(PARSED)).load(path).select("path", "content"), parse))
    known = rf"\.({'|'.join(PARSED + DECODED)})$"
    # only names are read here: a binary file's content is not, where it is not asked for
    other = [r.path for r in reader("binaryFile").load(path).select("path").filter(~F.lower("path").rlike(known)).limit(OTHERS + 1).collect()]
    if len(other) > OTHERS:
        rest = reader("image").load(path).filter(~F.lower("image.origin").rlike(known))
        decoded = decoded.unionByName(pictures(rest))
    elif other:
        decoded = decoded.unionByName(pictures(reader("image").load(other)))
    return _as_flags(decoded, flags)


def _as_flags(found: DataFrame, flags: int) -> DataFrame:
    if flags == UNCHANGED:
        return found
    at = lambda i, k: F.get("data", (i * F.col("cn") + k).cast("int"))
    places = F.when(F.col("h") * F.col("w") > 0, F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).otherwise(F.array().cast("array<int>"))
    if flags == GRAYSCALE:
        gray = F.transform(places, lambda i: F.when(F.col("cn") == 1, at(i, 0)).otherwise(F.shiftright(at(i, 0) * 7471 + at(i, 1) * 38470 + at(i, 2) * 19595 + 32768, 16)))
        return found.withColumn("data", gray).withColumn("cn", F.when(F.col("cn") > 0, 1).otherwise(0))
    three = F.flatten(F.transform(places, lambda i: F.array(*[F.when(F.col("cn") == 1, at(i, 0)).otherwise(at(i, k)) for k in range(3)])))
    return found.withColumn("data", three).withColumn("cn", F.when(F.col("cn") > 0, 3).otherwise(0))


def encode_png(h: int, w: int, cn: int, data: bytes) -> bytes:
    """A PNG of 1 to 4 channels in BGR(A) order."""
    rows = _turned(cn, data)
    raw = b"".join(b"\0" + rows[y * w * cn : (y + 1) * w * cn] for y in range(h))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[cn], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def encode_bmp(h: int, w: int, cn: int, data: bytes) -> bytes:
    """A 24-bit BMP; gray is repeated and alpha dropped."""
    stride = -(-3 * w // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = _three(h, w, cn, data).reshape(h, 3 * w)[::-1]
    size = 54 + stride * h
    return b"BM" + struct.pack("<IHHI", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 2835, 2835, 0, 0) + rows.tobytes()


def _three(h: int, w: int, cn: int, data: bytes) -> np.ndarray:
    """Rows, columns and three channels in BGR order; gray is repeated and alpha dropped."""
    pixels = np.frombuffer(data, np.uint8).reshape(h, w, cn)
    return pixels[..., :3] if cn > 2 else np.repeat(pixels[..., :1], 3, axis=2)


def _turned(cn: int, data: bytes) -> bytes:
    if cn < 3:
        return data
    out = bytearray(data)
    out[0::cn], out[2::cn] = data[2::cn], data[0::cn]
    return bytes(out)


ENCODERS = {"png": encode_png, "bmp": encode_bmp, "jpg": jpeg.encode, "jpeg": jpeg.encode}


def encoded(arrays: DataFrame, kind: str = "png", quality: int = jpeg.QUALITY) -> DataFrame:
    """``img_id, content``: files of dense 8U arrays, of integers or bytes; null where an array cannot be a picture.  JPEG files take a *quality* of 1 to 100."""
    import pyarrow as pa

    if kind not in ENCODERS:
        raise TensorError(f"no encoder for {kind!r}")
    if not 1 <= quality <= 100:
        raise TensorError(f"quality {quality} not in 1..100")
    encode = (lambda *a: jpeg.encode(*a, quality)) if kind in ("jpg", "jpeg") else ENCODERS[kind]

    def run(batches):
        for batch in batches:
            out = []
            for k in range(len(batch)):
                h, w, cn = (batch.column(c)[k].as_py() for c in ("h", "w", "cn"))
                values = _numbers(batch.column("data").slice(k, 1))
                fits = 1 <= cn <= 4 and len(values) == h * w * cn > 0 and values.min() >= 0 and values.max() <= 255
                out.append(encode(h, w, cn, values.astype(np.uint8).tobytes()) if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column("img_id"), pa.array(out, pa.binary())], ["img_id", "content"])

    return arrays.select("img_id", "h", "w", "cn", "data").mapInArrow(run, "img_id bigint, content binary")


class ImageSink(DataSource):
    """``df.write.format("tessera_images").mode("append").save(folder)`` for rows of ``img_id, content``.

    The folder has to be one that all executors mount; each file is written under its own name, so a repeated task overwrites with the same bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_images"

    def schema(self) -> str:
        return "img_id bigint, content binary"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"], self.options.get("extension", "png"))


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str, extension: str):
        self.folder, self.extension = folder.removeprefix("file:"), extension

    def write(self, rows):
        import os

        os.makedirs(self.folder, exist_ok=True)
        for r in rows:
            if r.content is not None:
                at = f"{self.folder}/{r.img_id}.{self.extension}"
                with open(f"{at}.part", "wb") as f:
                    f.write(bytes(r.content))
                os.replace(f"{at}.part", at)
        return WriterCommitMessage()


def imwrite(arrays: DataFrame, folder: str, kind: str = "png", quality: int = jpeg.QUALITY) -> None:
    """Writes dense 8U arrays as image files named by their ids."""
    arrays.sparkSession.dataSource.register(ImageSink)
    encoded(arrays, kind, quality).write.format("tessera_images").mode("append").option("extension", kind).save(folder)


def show(arrays: DataFrame, img_id: int) -> bytes | None:
    """The PNG of one array, for a notebook to display."""
    row = encoded(arrays.filter(F.col("img_id") == img_id)).first()
    return bytes(row.content) if row and row.content is not None else None
