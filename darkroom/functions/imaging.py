"""Pixel functions in numpy: resize, perceptual hashes, quality, thumbnails.  Spark decodes the pictures."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from darkroom.schema import PHASH_EDGE, SIMILARITY_EDGE, THUMB_EDGE

#: Ten-thousandths of red, green and blue in the grey of a pixel.
LUMA = np.array([2126, 7152, 722])


def luma8(colour: np.ndarray) -> np.ndarray:
    """8-bit greys of 8-bit colours, as whole numbers in floats."""
    return (eight_bit(colour).astype(np.int64) @ LUMA // 10_000).astype(float)


def eight_bit(pixels: np.ndarray) -> np.ndarray:
    """The nearest whole numbers from 0 to 255, as what follows compares pixels exactly."""
    return np.clip(np.floor(pixels + 0.5), 0, 255)


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit PNG of greys (height, width) or of red, green and blue (height, width, 3)."""
    height, width = pixels.shape[:2]
    rows = pixels.astype(np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def colours(image: dict | None) -> np.ndarray:
    """Red, green and blue (height, width, 3) of a decoded picture as Spark's image source gives it; ValueError if it could not be decoded."""
    if image is None or image["height"] is None or image["height"] <= 0 or image["width"] <= 0:
        raise ValueError("not a picture that can be decoded")
    pixels = np.frombuffer(image["data"], dtype=np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return pixels[:, :, 2::-1] if image["nChannels"] > 2 else np.repeat(pixels[:, :, :1], 3, axis=2)


def shrunk(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """:func:`resize` to 8-bit pixels."""
    return eight_bit(resize(grey, height, width))


def resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Separable triangle filter, widened when shrinking."""
    return _weights(grey.shape[0], height) @ grey @ _weights(grey.shape[1], width).T


def _weights(size: int, to: int) -> np.ndarray:
    scale = size / to
    reach = max(scale, 1.0)
    centres = (np.arange(to) + 0.5) * scale
    apart = np.abs(np.arange(size)[None] + 0.5 - centres[:, None]) / reach
    weights = np.maximum(0.0, 1.0 - apart)
    return weights / weights.sum(axis=1, keepdims=True)


def dct2(block: np.ndarray) -> np.ndarray:
    """Orthonormal two-dimensional DCT-II."""
    n = len(block)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    basis[0] = np.sqrt(1 / n)
    return basis @ block @ basis.T


def _bits(flags: np.ndarray) -> int:
    value = int("".join("1" if f else "0" for f in flags.ravel()), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def difference_hash(grey: np.ndarray) -> int:
    """64 bits: pixels of a 9 by 8 image brighter than their right neighbour."""
    small = shrunk(grey, 8, 9)
    return _bits(small[:, :-1] > small[:, 1:])


def perceptual_hash(grey: np.ndarray) -> int:
    """63 bits: low-frequency coefficients, without the first, above their mean."""
    low = np.round(dct2(shrunk(grey, PHASH_EDGE, PHASH_EDGE) / 255)[:8, :8].ravel()[1:], 9)  # equal pixels give equal bits
    return _bits(low > low.mean() + 1e-12)


def sharpness(grey: np.ndarray) -> float:
    """Variance of the absolute Laplacian, 1 at 12000 and above."""
    c = grey
    edge = np.abs(4 * c[1:-1, 1:-1] - c[:-2, 1:-1] - c[2:, 1:-1] - c[1:-1, :-2] - c[1:-1, 2:])
    return float(np.clip(edge.var() / 12000, 0, 1)) if edge.size else 0.0


def exposure(grey: np.ndarray) -> float:
    """Nearness of the mean to half and width of the spread."""
    unit = grey / 255
    return float(0.65 * (1 - np.clip(2 * abs(unit.mean() - 0.5), 0, 1)) + 0.35 * np.clip(unit.std() / 0.25, 0, 1))


def quality(buffer: np.ndarray, width: int, height: int) -> float:
    size = np.clip(width * height / 1e6 / 16, 0, 1)
    return float(100 * (0.35 * size + 0.40 * sharpness(buffer) + 0.25 * exposure(buffer)))


def similarity_buffer(grey: np.ndarray) -> np.ndarray:
    return shrunk(grey, SIMILARITY_EDGE, SIMILARITY_EDGE)


def thumbnail(colour: np.ndarray) -> np.ndarray:
    """Fitted into a square, never enlarged."""
    height, width = colour.shape[:2]
    scale = min(1.0, THUMB_EDGE / max(height, width))
    to = max(1, round(height * scale)), max(1, round(width * scale))
    return np.stack([shrunk(colour[:, :, c], *to) for c in range(3)], axis=2)


FEATURES = (
    "path string, sha256 string, width int, height int, phash bigint, dhash bigint, quality_score double, "
    "buffer binary, thumbnail binary, error string"
)


def features(pictures: DataFrame) -> DataFrame:
    """Visual features of (path, sha256, image), see :func:`darkroom.sources.files.pictures`.

    ``buffer`` has the 8-bit greys of a square that pictures are compared by, ``thumbnail`` a PNG.
    Files that do not decode get an error and nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a picture at a time, as one may be large
                path, sha, image = (batch.column(c)[row].as_py() for c in ("path", "sha256", "image"))
                try:
                    colour = colours(image)
                    grey = luma8(colour)
                    buffer = similarity_buffer(grey)
                    height, width = grey.shape
                    found = [path, sha, width, height, perceptual_hash(grey), difference_hash(grey), quality(buffer, width, height),
                             buffer.astype(np.uint8).tobytes(), encode_png(thumbnail(colour.astype(float))), None]
                except ValueError as error:  # one bad file does not stop the rest
                    found = [path, sha, *[None] * 7, str(error)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(found, TYPES)], NAMES)

    return pictures.select("path", "sha256", "image").mapInArrow(run, FEATURES)


NAMES = [c.split()[0] for c in FEATURES.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
TYPES = [_ARROW[c.split()[1]] for c in FEATURES.split(", ")]


def thumbnail_files(found: DataFrame, folder: str) -> DataFrame:
    """(sha256, thumbnail_path): the thumbnails of :func:`features` as ``{sha256}.png`` below ``folder``.

    The folder is of any file system that Arrow knows, one that all executors reach.  A file appears whole or not
    at all, and one that is there already is left, so that a task may run twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = system_of(folder)
        for batch in batches:
            paths = []
            for sha, data in zip(batch.column("sha256").to_pylist(), batch.column("thumbnail")):
                path = f"{at}/{sha}.png"
                if system.get_file_info(path).type == fs.FileType.NotFound:
                    own = f"{at}/.{sha}.{uuid4().hex}"
                    with system.open_output_stream(own) as file:
                        file.write(data.as_buffer())
                    system.move(own, path)
                paths.append(f"{folder.rstrip('/')}/{sha}.png")
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), pa.array(paths)], ["sha256", "thumbnail_path"])

    wanted = found.filter("thumbnail IS NOT NULL").select("sha256", "thumbnail").dropDuplicates(["sha256"])
    return wanted.mapInArrow(run, "sha256 string, thumbnail_path string")


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there; without a scheme that of the machine."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.rstrip("/") or "/")
