"""Grey images in the portable graymap format, as arrays; any other decoder can be passed in."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_HEADER = re.compile(rb"P([25])\s+(?:#[^\n]*\s+)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode_pgm(data: bytes) -> np.ndarray:
    """An image of a graymap file, plain or binary."""
    m = _HEADER.match(data)
    if not m:
        raise ValueError("no graymap")
    width, height, most = int(m[2]), int(m[3]), int(m[4])
    body = data[m.end() :]
    flat = np.array(body.split(), np.uint16) if m[1] == b"2" else np.frombuffer(body, np.uint8 if most < 256 else ">u2", width * height)
    return (flat[: width * height].reshape(height, width).astype(float) * 255 / most).round().astype(np.uint8)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(bands: np.ndarray, repeats: np.ndarray) -> bytes:
    """A black and white image as PNG of a bit a pixel, without loss: rows of truth values, and how often each row comes."""
    width, height = bands.shape[1], int(repeats.sum())
    packed = np.packbits(bands, axis=1)
    rows = np.zeros((len(bands), packed.shape[1] + 1), np.uint8)  # each row begins with its filter, which is none
    rows[:, 1:] = packed
    # a window of a few rows finds all that repeats, and a small one is made faster
    window = min(15, max(9, (4 * rows.shape[1]).bit_length()))
    deflate = zlib.compressobj(1, zlib.DEFLATED, window, 5)
    body = deflate.compress(np.repeat(rows, repeats, axis=0).tobytes()) + deflate.flush()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 1, 0, 0, 0, 0)) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The 0 and 255 of an image of ``encode_png``."""
    at, body, head = 8, b"", (0,) * 7
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("broken PNG")
        head, body = (struct.unpack(">IIBBBBB", part), body) if kind == b"IHDR" else (head, body + part if kind == b"IDAT" else body)
        at += 12 + size
    width, height, *rest = head
    if rest != [1, 0, 0, 0, 0]:
        raise ValueError("not of a bit a pixel")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, -1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return np.unpackbits(rows[:, 1:], axis=1)[:, :width] * np.uint8(255)


def resize(image: np.ndarray, scale: float) -> np.ndarray:
    """Scaled image: area means when it shrinks, linear interpolation when it grows."""
    h, w = (max(1, round(s * scale)) for s in image.shape)

    def weights(n: int, m: int) -> np.ndarray:
        if m <= n:
            edges = np.linspace(0, n, m + 1)
            k = np.arange(n)
            part = np.minimum(edges[1:, None], k + 1) - np.maximum(edges[:-1, None], k)
            return np.clip(part, 0, 1) * m / n
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        out = np.zeros((m, n))
        out[np.arange(m), low] = 1 - (at - low)
        if n > 1:
            out[np.arange(m), low + 1] = at - low
        return out

    return (weights(image.shape[0], h) @ image.astype(float) @ weights(image.shape[1], w).T).round().astype(np.uint8)


def scale_for(width: int, height: int, most: int) -> float:
    """The factor that brings the longer side down to the limit; never above 1."""
    return min(1.0, most / max(width, height))


def measured(spark: SparkSession, path: str, measure: Callable[[np.ndarray], tuple], columns: str, decode: Callable[[bytes], np.ndarray] = decode_pgm, pattern: str = "*.pgm") -> DataFrame:
    """path, width, height and the measure's columns of every image under a folder; files are decoded where they are read."""
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, data in zip(rows["path"], rows["content"], strict=True):
                image = decode(bytes(data))
                out.append((name, image.shape[1], image.shape[0], *measure(image)))
            yield pd.DataFrame(out, columns=["path", "width", "height", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, " + columns)
