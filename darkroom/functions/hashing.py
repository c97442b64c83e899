"""Content and perceptual hash functions as native columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from darkroom.schema import SLICE_BYTES


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def quick_fingerprint(content: Column, slice_bytes: int = SLICE_BYTES) -> Column:
    """Hash of the first, middle and last slice and the size; of small content the first slice only."""
    size = F.octet_length(content)
    mark = F.encode(size.cast("string"), "UTF-8")
    head = F.substring(content, 1, slice_bytes)
    middle = F.substring(content, (size / 2).cast("int") - slice_bytes // 2 + 1, F.lit(slice_bytes))
    tail = F.substring(content, size - slice_bytes + 1, F.lit(slice_bytes))
    whole = F.when(size <= 2 * slice_bytes, F.concat(head, mark)).otherwise(F.concat(head, middle, tail, mark))
    return F.sha2(whole, 256)


def bits_to_long(flags: Column) -> Column:
    """Booleans as the bits of a BIGINT, the first the most significant."""
    return F.aggregate(flags, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("bigint")))


def phash_of(values: Column) -> Column:
    """Bits of the values after the first that exceed their mean (63 of 64 values)."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    mean = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.size(rest)
    # as the variable of a lambda the mean is taken once, inside the inner one it would be for each value
    return F.transform(F.array(mean), lambda m: bits_to_long(F.transform(rest, lambda x: x > m)))[0]


def dhash_of(values: Column) -> Column:
    """Bits of values that exceed their right neighbour."""
    left = F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))
    right = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return bits_to_long(F.zip_with(left, right, lambda a, b: a > b))


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def from_hex16(text: Column) -> Column:
    """BIGINT with the bits of 16 hex digits; 0 for what does not parse."""
    good = text.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(good, F.conv(text, 16, -10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_to_bits(text: Column, n: int) -> Column:
    """The first n bits of the hex digits in a text, most significant first, padded with zeros."""
    digits = F.regexp_replace(text, "[^0-9a-fA-F]", "")
    padded = F.rpad(digits, -(-n // 4), "0")
    nibble = lambda i: F.conv(F.substring(padded, (i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    bit = lambda i: F.pmod(F.floor(nibble(i) / F.pow(F.lit(2), 3 - F.pmod(i, F.lit(4)))), F.lit(2)).cast("float")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), bit)


_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_WORDS = ((1, 0), (5, 1), (3, 5), (7, 0))


def md5_bytes(texts: pa.StringArray, at_once: int = 1 << 14) -> np.ndarray:
    """First byte of the md5 of each text; texts of at most 55 bytes, which are one block, are hashed side by side."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    out = np.zeros(len(texts), dtype=np.uint8)
    sizes = np.diff(offsets)
    for low in range(0, len(texts), at_once):
        size = sizes[low : low + at_once]
        short = np.flatnonzero(size <= 55)
        n = size[short]
        block = np.zeros((len(short), 64), dtype=np.uint8)
        inside = np.arange(55)[None, :] < n[:, None]
        block[:, :55][inside] = data[(offsets[low + short][:, None] + np.arange(55)[None, :])[inside]]
        block[np.arange(len(short)), n] = 0x80
        block.view("<u4")[:, 14] = n * 8
        out[low + short] = _md5_first(np.ascontiguousarray(block.view("<u4").T))
    for i in np.flatnonzero(sizes > 55).tolist():
        out[i] = hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes()).digest()[0]
    return out


def _md5_first(words: np.ndarray) -> np.ndarray:
    """First bytes of the digests of blocks, given as 16 rows of words."""
    a, b, c, d = (np.full(words.shape[1], x, dtype=np.uint32) for x in _MD5_START)
    for i in range(64):
        kind = i // 16
        mixed = _md5_mixed(kind, b, c, d)
        times, plus = _MD5_WORDS[kind]
        mixed += a
        mixed += words[(times * i + plus) % 16]
        mixed += _MD5_ADDED[i]
        turn = np.uint32(_MD5_TURNS[kind][i % 4])
        a, d, c, b = d, c, b, b + ((mixed << turn) | (mixed >> (np.uint32(32) - turn)))
    return (a + np.uint32(_MD5_START[0])).astype(np.uint8)


def _md5_mixed(kind: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if kind == 0:
        return d ^ (b & (c ^ d))
    if kind == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if kind == 2 else c ^ (b | ~d)
