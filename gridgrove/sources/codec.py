"""PNG and PGM images as grids and back, with the standard library alone.

Files are read as binaryFile rows and decoded by Arrow batches, a file a row; images of one call have one size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgrove.sources.grid import Grid

# The file signature and the channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes after a PNG's line filters."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if kind == 0:
            done = line
        elif kind == 2:
            done = (line + above) & 255
        elif kind == 1:  # each place of a pixel is a running sum
            done = np.concatenate([np.cumsum(line.reshape(-1, step), axis=0).ravel()]) & 255
        elif kind in (3, 4):
            done = np.zeros(stride, np.int64)
            for i in range(stride):
                a = done[i - step] if i >= step else 0
                b = above[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[i] = (line[i] + guess) & 255
        else:
            raise ValueError("unknown PNG filter")
        out[y] = done
        above = done
    return out


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG of 8 or 16 bits a sample that isn't interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("a PNG file without a header")
    width, height, bits, colour, _, _, interlaced = head
    if bits not in (8, 16) or colour not in CHANNELS or interlaced:
        raise ValueError("only 8 and 16 bits, grey or colour, not interlaced")
    channels = CHANNELS[colour]
    step = channels * bits // 8
    rows = _unfilter(zlib.decompress(b"".join(body)), height, width * step, step)
    return rows.view(">u2" if bits == 16 else np.uint8).reshape(height, width, channels).astype(np.uint16)


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of 16 bits of (height, width, 1 or 3)."""
    height, width, channels = image.shape
    if channels not in (1, 3):
        raise ValueError("one or three channels")
    lines = image.astype(">u2").reshape(height, -1).view(np.uint8)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), lines], axis=1).tobytes()

    def chunk(kind: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    head = struct.pack(">IIBBBBB", width, height, 16, 0 if channels == 1 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_pgm(data: bytes) -> np.ndarray:
    """(height, width, 1) of a PGM, plain (P2) or raw (P5)."""
    if data[:2] not in (b"P2", b"P5"):
        raise ValueError("not a PGM file")
    at, numbers = 2, []
    while len(numbers) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    width, height, top = numbers
    if data[:2] == b"P2":
        values = np.array(data[at:].split()[: width * height], np.int64)
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, width * height, at + 1)
    return values.astype(np.uint16).reshape(height, width, 1)


def encode_pgm(image: np.ndarray) -> bytes:
    """A raw PGM of (height, width, 1)."""
    height, width, _ = image.shape
    top = 255 if image.max(initial=0) <= 255 else 65535
    return b"P5\n%d %d\n%d\n" % (width, height, top) + image.astype(np.uint8 if top == 255 else ">u2").tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_pgm(data) if data[:1] == b"P" else decode_png(data)


def read_images(spark: SparkSession, path: str) -> Grid:
    """The images of a path or pattern as one grid, numbered in the order of their paths."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    order = {r[0]: k for k, r in enumerate(files.select("path").orderBy("path").limit(100_001).collect())}
    if len(order) > 100_000:
        raise ValueError("at most 100,000 files a call")
    if not order:
        raise ValueError("no image there")

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                image = decode(bytes(content))
                h, w, c = image.shape
                yield pd.DataFrame({"image_id": order[path], "h": h, "w": w, "p": np.arange(h * w), "v": list(image.reshape(-1, c).astype(float))})

    rows = files.mapInPandas(pixels, "image_id bigint, h int, w int, p bigint, v array<double>")
    sizes = rows.groupBy("h", "w", F.size("v").alias("c")).count().collect()
    if len(sizes) != 1:
        raise ValueError("the images have different sizes")
    h, w, c = (int(sizes[0][k]) for k in ("h", "w", "c"))
    return Grid(rows.select("image_id", F.expr(f"p div {w}").alias("y"), (F.col("p") % w).alias("x"), "p", "v"), h, w, c, 16)


def to_images(grid: Grid, kind: str = "png") -> DataFrame:
    """(image_id, content): each image as a file's bytes."""
    h, w, c = grid.height, grid.width, grid.channels

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((h * w, c), np.uint16)
        image[part.p.to_numpy()] = np.stack(part.v.to_numpy()).astype(np.uint16)
        made = (encode_png if kind == "png" else encode_pgm)(image.reshape(h, w, c))
        return pd.DataFrame({"image_id": [part.image_id.iloc[0]], "content": [made]})

    return grid.pixels.select("image_id", "p", "v").groupBy("image_id").applyInPandas(encode, "image_id bigint, content binary")


def planes(grid: Grid) -> DataFrame:
    """(image_id, i, sample): channel after channel."""
    n = grid.size
    return grid.pixels.select("image_id", "p", F.posexplode("v").alias("c", "sample")).select("image_id", (F.col("c") * n + F.col("p")).alias("i"), "sample")
