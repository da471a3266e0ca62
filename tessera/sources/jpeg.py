"""Baseline JPEG files, coded with the symbol counts of each image.

An image is transformed and quantised in blocks of 8 x 8 at full colour resolution.  Coefficients become entries, a
symbol with extra bits, for all blocks at once; runs of zeros are distances between non-zero places.
Code lengths are optimal for the image's own counts, at most 16 bits, by package-merge.
"""

from __future__ import annotations

import struct

import numpy as np

#: Quality of files where none is given.
QUALITY = 95
#: Longest code.
MOST_BITS = 16

# The standard's example quantisation of luminance and of chrominance, row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: Places of a block from low frequencies to high ones.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def quantisation(values: list[int], quality: int) -> np.ndarray:
    """A table scaled to a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(values) * scale + 50) // 100, 1, 255)


def code_lengths(counts: dict[int, int], most: int = MOST_BITS) -> dict[int, int]:
    """Lengths of optimal prefix codes of at most *most* bits; one place of the longest length is left free, as JPEG wants no code of ones alone."""
    leaves = sorted([(n, (s,)) for s, n in counts.items()] + [(0, (-1,))])
    packages: list[tuple[int, tuple]] = []
    for _ in range(most):
        level = sorted(leaves + packages, key=lambda p: p[0])
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
    out: dict[int, int] = {}
    for _, symbols in packages[: len(leaves) - 1]:
        for s in symbols:
            out[s] = out.get(s, 0) + 1
    # the free place has to be the last one of the longest codes
    free, longest = out.pop(-1), max(out.values())
    if free < longest:
        other = next(s for s, n in out.items() if n == longest)
        out[other] = free
    return out


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Numbers of codes by length, symbols in order, and the codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        codes[s], last, code = code, lengths[s], code + 1
    return [sum(n == k for n in lengths.values()) for k in range(1, MOST_BITS + 1)], order, codes


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitudes of integers."""
    return np.frexp(np.abs(v).astype(np.float64))[1] * (v != 0)


def coefficients(planes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Quantised coefficients (blocks, planes, 64) of planes whose sides are whole blocks, in zigzag order."""
    k = np.arange(8)
    cosines = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)
    blocks = planes.reshape(len(planes), planes.shape[1] // 8, 8, planes.shape[2] // 8, 8).transpose(1, 3, 0, 2, 4)
    steps = np.stack(tables).reshape(len(tables), 8, 8)[[min(p, len(tables) - 1) for p in range(len(planes))]]
    found = np.rint(cosines @ blocks @ cosines.T / steps).astype(np.int64)
    return np.clip(found, -1023, 1023).reshape(-1, len(planes), 64)[..., ZIGZAG]


def entries(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code table (two for luma, two for chroma), symbol, extra bits and their number, in the order of the file."""
    blocks, planes, _ = found.shape
    dc = np.diff(found[:, :, 0], axis=0, prepend=0).reshape(-1)
    flat = found.reshape(-1, 64)
    number = np.arange(len(flat))
    row, at = np.nonzero(flat[:, 1:])
    at = at + 1
    value = flat[row, at]
    before = np.where(np.append([-1], row[:-1]) == row, np.append([0], at[:-1]), 0)
    run = at - before - 1
    last = np.zeros(len(flat), np.int64)
    np.maximum.at(last, row, at)
    size = _size(value).astype(np.int64)
    long_runs = np.repeat(np.arange(len(row)), run // 16)
    ends = np.flatnonzero(last < 63)
    kinds = [
        (number, np.zeros(len(flat), np.int64), _size(dc).astype(np.int64), dc, 0),
        (row[long_runs], at[long_runs] * 2, np.full(len(long_runs), 0xF0), np.zeros(len(long_runs), np.int64), 1),
        (row, at * 2 + 1, run % 16 << 4 | size, value, 1),
        (ends, np.full(len(ends), 200), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), 1),
    ]
    order = np.argsort(np.concatenate([k[0] * 256 + k[1] for k in kinds]), kind="stable")
    joined = lambda n: np.concatenate([k[n] for k in kinds])[order]
    chroma = joined(0) % planes > 0
    alternating = np.concatenate([np.full(len(k[0]), k[4]) for k in kinds])[order]
    symbol, value = joined(2), joined(3)
    bits = np.where(alternating == 1, symbol & 15, symbol)
    return chroma * 2 + alternating, symbol, np.where(value < 0, value + (1 << bits) - 1, value), bits


def packed_bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Numbers of given lengths one after another, filled up with ones."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.ones(-(-total // 8) * 8, np.uint8)
    starts = ends - lengths
    for b in range(int(lengths.max(initial=0))):
        held = np.flatnonzero(lengths > b)
        out[starts[held] + b] = values[held] >> (lengths[held] - 1 - b) & 1
    return np.packbits(out).tobytes()


def encode(h: int, w: int, cn: int, data: bytes, quality: int = QUALITY) -> bytes:
    """A file of an array in BGR order; alpha is dropped."""
    pixels = np.frombuffer(data, np.uint8).reshape(h, w, cn).astype(np.float64)
    if cn > 2:
        b, g, r = pixels[..., 0], pixels[..., 1], pixels[..., 2]
        luma = 0.299 * r + 0.587 * g + 0.114 * b
        planes, tables = np.stack([luma - 128, (b - luma) / 1.772, (r - luma) / 1.402]), [quantisation(t, quality) for t in (LUMINANCE, CHROMINANCE)]
    else:
        planes, tables = pixels[..., 0][None] - 128, [quantisation(LUMINANCE, quality)]
    planes = np.pad(planes, ((0, 0), (0, -h % 8), (0, -w % 8)), mode="edge")
    table, symbol, extra, bits = entries(coefficients(planes, tables))
    value, length, heads = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64), []
    for t in range(2 * len(tables)):
        held = np.flatnonzero(table == t)
        seen, at, counts = np.unique(symbol[held], return_inverse=True, return_counts=True)
        lengths = code_lengths(dict(zip(seen.tolist(), counts.tolist(), strict=True)))
        numbers, order, codes = canonical(lengths)
        value[held] = np.array([codes[s] for s in seen.tolist()])[at.reshape(-1)] << bits[held] | extra[held]
        length[held] = np.array([lengths[s] for s in seen.tolist()])[at.reshape(-1)] + bits[held]
        heads.append(bytes([(t % 2) << 4 | t // 2, *numbers, *order]))
    part = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    kinds = [(c + 1, min(c, len(tables) - 1)) for c in range(len(planes))]
    return b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), *(part(0xDB, bytes([n, *t[ZIGZAG].tolist()])) for n, t in enumerate(tables)),
        part(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([c, 0x11, t]) for c, t in kinds)), *(part(0xC4, head) for head in heads),
        part(0xDA, bytes([len(planes)]) + b"".join(bytes([c, t << 4 | t]) for c, t in kinds) + b"\0\x3f\0"), packed_bits(value, length).replace(b"\xff", b"\xff\0"), b"\xff\xd9",
    ])
