"""Byte-level BPE encoding and decoding from a rank file.

Two tiers: a minimal perfect hash resolves pre-tokens that are vocabulary entries as a whole; the
others are merged by a heap of pair ranks over a doubly linked list of bytes.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import map_arrow, slices, tokenizer_path


class MinimalPerfectHash:
    """Hash and displace: ``n`` keys onto the slots 0 to n - 1, each slot used once.

    A key's first hash names its bucket; the bucket's displacement pair ``(a, b)`` puts the key
    into slot ``(h1 + a * h2 + b) % n``.  Buckets are placed from the largest to the smallest.
    """

    PER_BUCKET = 4

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // self.PER_BUCKET)
        members: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for index, (bucket, h1, h2) in enumerate(zip(*(h.tolist() for h in self._hashes(keys)))):
            members[bucket].append((h1, h2, index))
        taken = np.zeros(n, dtype=bool)
        self.displacement = np.zeros(self.buckets, dtype=np.int64)
        self.slot_key: list[bytes] = [b""] * n
        self.slot_value = [-1] * n
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not members[bucket]:
                break
            displacement, slots = self._displace(members[bucket], taken)
            self.displacement[bucket] = displacement
            for (_, _, index), slot in zip(members[bucket], slots):
                taken[slot] = True
                self.slot_key[slot] = keys[index]
                self.slot_value[slot] = index

    def _hashes(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        low = np.uint64(0xFFFFFFFF)
        return (
            ((h & low) % np.uint64(self.buckets)).astype(np.int64),
            ((h >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64),
            (np.uint64(1) + (mixed >> np.uint64(32)) % np.uint64(max(1, self.n - 1))).astype(np.int64),
        )

    def _displace(self, members: list[tuple[int, int, int]], taken: np.ndarray) -> tuple[int, list[int]]:
        h1 = np.array([m[0] for m in members])
        h2 = np.array([m[1] for m in members])
        if len(members) == 1:
            slot = int(np.argmin(taken))
            return (slot - int(h1[0])) % self.n, [slot]
        for a in range(self.n):
            base = (h1 + a * h2) % self.n
            if len(set(base.tolist())) < len(members):
                continue
            # All shifts of this base at once, in blocks.
            for low in range(0, self.n, 4096):
                shifts = np.arange(low, min(low + 4096, self.n))
                free = ~taken[(base[:, None] + shifts) % self.n].any(axis=0)
                if free.any():
                    shift = int(shifts[np.argmax(free)])
                    return a * self.n + shift, ((base + shift) % self.n).tolist()
        raise ValueError("two keys are equal")

    def find(self, keys: list[bytes]) -> list[int]:
        """Each key's index, or -1 if it is not one of the keys."""
        bucket, h1, h2 = self._hashes(keys)
        a, shift = np.divmod(self.displacement[bucket], self.n)
        slots = ((h1 + a * h2 + shift) % self.n).tolist()
        held, values = self.slot_key, self.slot_value
        return [values[slot] if held[slot] == key else -1 for key, slot in zip(keys, slots)]


class ByteBpe:
    """Encoder and decoder for one rank file.

    Encodings of pre-tokens are kept in a memo of bounded size, so that a repeated word is merged
    once; results do not depend on it.
    """

    MEMO, MEMO_CHARACTERS = 800_000, 16 << 20
    #: Pieces that share a heap.
    AT_ONCE = 256

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        keys = list(ranks)
        self.whole = MinimalPerfectHash(keys)
        self.rank_of_key = list(ranks.values())
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.full((256, 256), -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank
        # Rank of the token that two adjacent tokens form, by (left << 32 | right).
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.pattern = regex.compile(pattern)
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_characters = 0

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Per piece, merge the pair of lowest rank, the leftmost among equals, until none is left.

        The pieces share one heap over one linked list of bytes that has no link from piece to piece.
        """
        if not pieces:
            return []
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(raw)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        ranks = np.full(n + 1, -1, dtype=np.int64)
        ranks[: n - 1] = self.byte_pairs[raw[:-1], raw[1:]]
        ranks[ends - 1] = -1
        at = np.flatnonzero(ranks >= 0)
        # A heap entry is rank << 32 | position; it is stale if the pair there has another rank.
        heap = np.sort(ranks[at] << 32 | at).tolist()  # sorted, hence a heap
        links = np.arange(1, n + 1)
        links[ends - 1] = n
        after = links.tolist()
        links = np.arange(-1, n - 1)
        links[starts] = -1
        before = links.tolist()
        rank_at, ids, pair = ranks.tolist(), self.of_byte[raw].tolist(), self.pairs.get
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            merged = entry >> 32
            if rank_at[i] != merged:
                continue
            gone = after[i]
            ids[i] = merged
            ids[gone] = rank_at[gone] = -1
            j = after[i] = after[gone]
            if j < n:
                before[j] = i
                rank = rank_at[i] = pair(merged << 32 | ids[j], -1)
                if rank >= 0:
                    heappush(heap, rank << 32 | i)
            else:
                rank_at[i] = -1
            h = before[i]
            if h >= 0:
                rank = rank_at[h] = pair(ids[h] << 32 | merged, -1)
                if rank >= 0:
                    heappush(heap, rank << 32 | h)
        found = np.array(ids)
        left = found >= 0
        cuts = np.cumsum(np.add.reduceat(left, starts, dtype=np.int64)).tolist()
        flat = found[left].tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, matches: list[str]) -> None:
        """Memo of pre-tokens: one id where the hash finds the whole, else the merged bytes."""
        pieces = [m.encode() for m in matches]
        keys = self.whole.find(pieces)
        misses = [i for i, k in enumerate(keys) if k < 0]
        self.memo.update((matches[i], (self.rank_of_key[k],)) for i, k in enumerate(keys) if k >= 0)
        for low in range(0, len(misses), self.AT_ONCE):
            some = misses[low : low + self.AT_ONCE]
            merged = self.merge([pieces[i] for i in some])
            self.memo.update((matches[i], tuple(ids)) for i, ids in zip(some, merged))
        self.memo_characters += sum(map(len, matches))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern on its own."""
        memo = self.memo
        if len(memo) > self.MEMO or self.memo_characters > self.MEMO_CHARACTERS:
            memo.clear()
            self.memo_characters = 0
        matches = self.pattern.findall(text)
        new = set(matches).difference(memo)
        if new:
            self._learn(list(new))
        return list(chain.from_iterable(map(memo.__getitem__, matches)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def encode_decode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text), then decode the ids.

    ``vocabulary`` is a rank file that holds all 256 single bytes.  A null or empty text has no
    ids.  Repeated rows are encoded each; extra columns are ignored.  Returns doc_id, n_tokens,
    ids_sha256 (of the decimal ids joined by spaces) and decoded_sha256 (of the decoded bytes).
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path, pattern)
        counts, of_ids, of_bytes = [], [], []
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        digest,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


_CODERS: dict[tuple[str, str | None], ByteBpe] = {}


def coder(path: str, pattern: str | None = None) -> ByteBpe:
    """One coder per Python worker and rank file."""
    if (path, pattern) not in _CODERS:
        import public_tokenizers

        _CODERS[path, pattern] = ByteBpe(read_ranks(path), pattern or public_tokenizers.PATTERN)
    return _CODERS[path, pattern]
