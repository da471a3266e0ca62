"""Image files written here and read back, and files made by hand."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.depths import TensorError
from tessera.sources import images, jpeg


def arrays_of(spark, found):
    rows = [(i, *a.shape, a.ravel().tolist()) for i, a in enumerate(found)]
    return spark.createDataFrame(rows, "img_id bigint, h int, w int, cn int, data array<int>")


def read(spark, folder, flags=images.UNCHANGED):
    return {r.path.rsplit("/", 1)[-1].split(".")[0]: np.array(r.data).reshape(r.h, r.w, r.cn) for r in images.imread(spark, str(folder), flags).collect()}


@pytest.fixture(scope="module")
def pictures():
    y, x = np.mgrid[:37, :50]
    smooth = np.stack([128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), (x + y) * 2.5], axis=-1).clip(0, 255).astype(int)
    noise = np.random.default_rng(1).integers(0, 256, (16, 24, 3))
    return [smooth, smooth[..., :1], noise, np.full((1, 1, 3), 200)]


@pytest.mark.parametrize("kind", ["png", "bmp"])
def test_exact_formats(spark, tmp_path, pictures, kind):
    images.imwrite(arrays_of(spark, pictures), str(tmp_path / kind), kind)
    got = read(spark, tmp_path / kind, images.COLOR)
    for i, want in enumerate(pictures):
        assert (got[str(i)] == np.broadcast_to(want, (*want.shape[:2], 3))).all()


def test_jpeg(spark, tmp_path, pictures):
    images.imwrite(arrays_of(spark, pictures), str(tmp_path / "jpg"), "jpg")
    got = read(spark, tmp_path / "jpg", images.COLOR)
    for i, (want, most) in enumerate(zip(pictures, (2.5, 2.5, 12, 3), strict=True)):
        apart = got[str(i)] - np.broadcast_to(want, (*want.shape[:2], 3))
        assert np.sqrt((apart**2).mean()) < most
    assert jpeg.encode(8, 8, 1, bytes(64))[:2] == b"\xff\xd8"


def test_jpeg_quality_and_codes(spark, tmp_path, pictures):
    sizes, errors = {}, {}
    for quality in (20, 75, 95):
        images.imwrite(arrays_of(spark, pictures).withColumn("data", F.unhex(F.array_join(F.transform("data", lambda v: F.lpad(F.hex(v), 2, "0")), ""))), str(tmp_path / str(quality)), "jpeg", quality)
        got = read(spark, tmp_path / str(quality), images.COLOR)
        errors[quality] = np.sqrt(np.mean([((got[str(i)] - np.broadcast_to(p, (*p.shape[:2], 3))) ** 2).mean() for i, p in enumerate(pictures)]))
        sizes[quality] = sum(f.stat().st_size for f in (tmp_path / str(quality)).glob("*.jpeg"))
    assert sizes[20] < sizes[75] < sizes[95] and errors[95] < errors[75] < errors[20]
    with pytest.raises(TensorError):
        images.encoded(arrays_of(spark, pictures), "jpg", 0)


def test_code_lengths_are_optimal_and_bounded():
    rng = np.random.default_rng(3)
    for counts in ({5: 7}, {0: 1, 1: 1}, {k: 2**k for k in range(30)}, {k: int(n) for k, n in enumerate(rng.integers(1, 1000, 200))}):
        lengths = jpeg.code_lengths(counts)
        assert set(lengths) == set(counts) and 1 <= min(lengths.values()) and max(lengths.values()) <= 16
        assert sum(2.0**-n for n in lengths.values()) < 1  # no code of ones alone
        _, order, codes = jpeg.canonical(lengths)
        words = [f"{codes[s]:0{lengths[s]}b}" for s in order]
        assert not any(a != b and b.startswith(a) for a in words for b in words) and all("0" in x for x in words)
        if len(counts) == 200:
            total = sum(counts.values())
            entropy = -sum(n * np.log2(n / total) for n in counts.values())
            assert entropy <= sum(counts[s] * n for s, n in lengths.items()) < entropy + 0.1 * total


def test_other_names_and_broken_files(spark, tmp_path, pictures):
    images.imwrite(arrays_of(spark, pictures[:2]), str(tmp_path), "png")
    (tmp_path / "0.png").rename(tmp_path / "plain_name")
    (tmp_path / "1.png").rename(tmp_path / "UPPER.PNG")
    (tmp_path / "note.txt").write_text("no picture")
    (tmp_path / "broken.png").write_bytes(b"\x89PNG no more")
    (tmp_path / "gray.PGM").write_bytes(b"P5 2 1 255\n\x07\x09")
    got = read(spark, tmp_path)
    assert set(got) == {"plain_name", "UPPER", "note", "broken", "gray"}
    assert (got["plain_name"] == pictures[0]).all() and got["note"].size == got["broken"].size == 0 and got["gray"].ravel().tolist() == [7, 9]
    for size in (b"-Y x +X 2", b"-Y -1 +X 2", b"-Y 99999999 +X 99999999", b"-Y 0 +X 4"):
        assert images.parse_hdr(b"#?RADIANCE\n\n" + size + b"\n" + bytes(40)) is None


def test_hdr(spark, tmp_path):
    rng = np.random.default_rng(2)
    for name, w in (("flat", 5), ("runs", 12)):
        pixels = rng.integers(1, 256, (3, w, 4)).astype(np.uint8)
        pixels[..., 3] = rng.integers(125, 131, (3, w))
        pixels[0, 0, 3] = 0
        body = pixels.tobytes()
        if name == "runs":
            body = b""
            for row in pixels:
                body += b"\x02\x02" + struct.pack(">H", w)
                for k in range(4):
                    body += bytes([w - 3]) + row[: w - 3, k].tobytes() + b"".join(bytes([129, v]) for v in row[w - 3 :, k])
        (tmp_path / f"{name}.hdr").write_bytes(b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n" + f"-Y 3 +X {w}\n".encode() + body)
        light = pixels[..., :3] * np.where(pixels[..., 3:] > 0, 2.0 ** (pixels[..., 3:].astype(float) - 136), 0)
        want = np.clip(np.floor(light ** (1 / 2.2) * 255 + 0.5), 0, 255)[..., ::-1]
        assert (read(spark, tmp_path / f"{name}.hdr")[name] == want).all()
    assert images.parse_hdr(b"#?RADIANCE\n\n-Y 2 +X 9\n\x02\x02") is None and images.parse_hdr(b"") is None
