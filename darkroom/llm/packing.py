"""Pack tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import slices, tokenizer_path

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
#: Sequence ids of partition p start at p << PARTITION_SHIFT.
PARTITION_SHIFT = 36


class SumOfSquares:
    """Online packing of pieces into windows of ``size`` tokens.

    ``count[h]`` is the number of open windows filled to level ``h``.  A piece of length ``s`` goes
    into the level whose change of ``sum(count[h] ** 2)`` is least: moving a window from ``h`` to
    ``h + s`` changes the sum by ``2 * (count[h + s] - count[h]) + 2``, closing it (``h + s ==
    size``) by ``1 - 2 * count[h]``, and opening one by ``2 * count[s] + 1``.  Ties go to the
    fullest level.
    """

    def __init__(self, size: int, first_id: int = 0):
        self.size, self.next_id = size, first_id
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]  # window ids by level

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece of 1 to ``size`` tokens."""
        if length == self.size:
            return self.new(), 0
        count, top = self.count, self.size - length
        # Levels top, top - 1, .. 1: the piece raises them to size, size - 1, .. length + 1.
        gain = 2 * (count[length + 1 : self.size + 1] - count[1 : top + 1]) + 2
        gain[-1] = 1 - 2 * count[top]
        gain[count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        best = len(gain) - 1 - int(np.argmin(gain[::-1]))
        if gain[best] <= 2 * count[length] + 1:
            level = best + 1
            window = self.open[level].pop()
            count[level] -= 1
        else:
            level, window = 0, self.new()
        if level + length < self.size:
            self.open[level + length].append(window)
            count[level + length] += 1
        return window, level


    def take(self, level: int) -> int:
        """An open window of ``level``, no longer open."""
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, window: int, level: int) -> None:
        """``window`` is open and filled to ``level``."""
        self.open[level].append(window)
        self.count[level] += 1

    def levels(self) -> np.ndarray:
        """The levels of open windows, ascending."""
        return np.flatnonzero(self.count)


def top_up(packer: SumOfSquares, held: dict[int, list[list]]) -> int | None:
    """Fill the fullest open window with pieces cut from the emptiest ones.

    ``held`` has each open window's pieces as ``[document, start, length]``.  Returns the window,
    which is full and no longer open; None if all that is open does not fill one.
    """
    top = int(packer.levels()[-1])
    window = packer.take(top)
    room = packer.size - top
    while room and packer.count.any():
        level = int(packer.levels()[0])
        giver = packer.take(level)
        while room and held[giver]:
            document, start, length = held[giver].pop()
            some = min(length, room)
            held[window].append([document, start + length - some, some])
            if some < length:
                held[giver].append([document, start, length - some])
            level, room = level - some, room - some
        if held[giver]:
            packer.put(giver, level)
        else:
            del held[giver]
    if room:
        packer.put(window, packer.size - room)
        return None
    return window


def powers_of_two(packer: SumOfSquares, pieces: list[list]) -> Iterator[tuple[list, int, int]]:
    """Cut the pieces of a window that cannot be filled into sequences of powers of two, which need
    no padding.  Yields ``(piece, window, offset)``."""
    left = sum(length for _, _, length in pieces)
    room = offset = window = 0
    for document, start, length in pieces:
        while length:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                window, offset = packer.new(), 0
            some = min(length, room)
            yield [document, start, some], window, offset
            start, length, room, offset = start + some, length - some, room - some, offset + some


def pack(
    docs: DataFrame,
    max_tokens: int = 2048,
    vocabulary: str | None = None,
    end_id: int = 1,
    max_open: int = 4096,
) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of ``max_tokens`` tokens.

    A document is its text's ids, special strings as the library reads them, then ``end_id``; a
    null or empty text is ``end_id`` alone.  Whole windows are cut from documents longer than a
    window; each remainder is placed by :class:`SumOfSquares`.  Partitions pack on their own, so
    there is no shuffle and no task sees more than its own rows.  Only ids of open windows are held:
    beyond ``max_open`` of them the fullest is topped up by cutting pieces of the emptiest (see
    :func:`top_up`), as are all that are open at a partition's end.  There is no padding.  Repeated
    rows are packed each; extra columns are ignored; an empty table gives no rows.  One row per piece.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(path), np.array([end_id], dtype="<u4")
        context = TaskContext.get()
        packer = SumOfSquares(max_tokens, (context.partitionId() if context else 0) << PARTITION_SHIFT)
        rows: list[tuple] = []
        open_pieces: dict[int, list[list]] = {}
        ids_of: dict[int, np.ndarray] = {}  # remainder ids of documents in open windows
        about: dict[int, tuple[int | None, int, int]] = {}  # doc_id, tokens, first id kept
        left: dict[int, int] = {}  # remainder ids that have not gone out
        serial = 0

        def emit(piece: list, window: int, offset: int) -> None:
            document, start, length = piece
            doc_id, total, base = about[document]
            ids = ids_of[document][start - base : start - base + length]
            rows.append((doc_id, start, length, zlib.crc32(ids.tobytes()), total, window, offset))

        def close(window: int) -> None:
            offset = 0
            for piece in open_pieces.pop(window):
                emit(piece, window, offset)
                offset += piece[2]
                drop(piece)

        def drop(piece: list) -> None:
            """Forget a document when its last id has gone out."""
            left[piece[0]] -= piece[2]
            if not left[piece[0]]:
                for kept in (ids_of, about, left):
                    kept.pop(piece[0])

        def take_rows() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                doc_ids = batch.column("doc_id").to_pylist()
                for doc_id, text in zip(doc_ids, texts):
                    ids = np.concatenate([encode(text), end])
                    total = len(ids)
                    full = total // max_tokens * max_tokens
                    for start in range(0, full, max_tokens):
                        crc = zlib.crc32(ids[start : start + max_tokens].tobytes())
                        rows.append((doc_id, start, max_tokens, crc, total, packer.new(), 0))
                    if full == total:
                        continue
                    serial += 1
                    ids_of[serial] = ids[full:].copy()
                    about[serial] = (doc_id, total, full)
                    left[serial] = total - full
                    window, offset = packer.place(total - full)
                    open_pieces.setdefault(window, []).append([serial, full, total - full])
                    if offset + total - full == max_tokens:
                        close(window)
                    elif len(open_pieces) > max_open:
                        filled = top_up(packer, open_pieces)
                        if filled is not None:
                            close(filled)
                if len(rows) >= 4096:
                    yield take_rows()
        while packer.count.any():
            window = top_up(packer, open_pieces)
            if window is None:
                for piece, window, offset in powers_of_two(packer, open_pieces[int(packer.open[packer.levels()[0]][0])]):
                    emit(piece, window, offset)
                break
            close(window)
            if len(rows) >= 4096:
                yield take_rows()
        if rows:
            yield take_rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}
#: Outside these, regex engines may differ on what is a letter, a digit or a blank.
ODD = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u203a]")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text by a byte-level vocabulary file, as little-endian unsigned 32-bit numbers.

    Texts of Latin letters go through tiktoken with the ranks of the same file, which is several
    times faster and gives the same ids; all others go through the tokenizers library itself.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = cache(lambda: Tokenizer.from_file(path))  # read when first needed
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in described["model"]["vocab"].items()
            if token not in special
        }
        fast = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        ).encode_to_numpy

        def encode(text: str) -> np.ndarray:
            if ODD.search(text):
                return np.array(tokenizer().encode(text, add_special_tokens=False).ids, dtype="<u4")
            return fast(text, allowed_special="all").astype("<u4", copy=False)

        _ENCODERS[path] = encode
    return _ENCODERS[path]
