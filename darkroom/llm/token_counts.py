"""Count the tokens of whole texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import by_bytes, map_arrow, slices, tokenizer_path
from darkroom.llm.segments import cut

#: Characters above which a text is split, and those of one call of a library.
PART = 1 << 14


def count_tokens(
    docs: DataFrame, vocabulary: str | None = None, limit: int = 4096, batch_bytes: int = 4 << 20
) -> DataFrame:
    """Number of tokens of every text of ``docs`` (doc_id, text).

    Arrow batches are cut into slices of about ``batch_bytes`` bytes of text; texts of any length
    are split at safe boundaries (see :mod:`darkroom.llm.segments`), encoded in calls of about
    equal size, and only lengths are kept.  A ``.model`` vocabulary is read by sentencepiece, a
    ``.json`` one by tokenizers.  A null or empty text has 0 bytes and 0 tokens.  Repeated rows
    are counted each; extra columns are ignored.  Returns doc_id, n_bytes, n_tokens, over_limit.
    """
    path = vocabulary or tokenizer_path("piece_bpe_32k.model")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, keep_space = _library(path)
        totals: list[int] = []
        for part in slices(batch, "text", batch_bytes):
            cuts = [cut(t or "", PART, keep_space) for t in part.column("text").to_pylist()]
            found = (n for run in by_bytes((s for c in cuts for s in c), PART) for n in lengths(run))
            totals += [sum(next(found) for _ in c) for c in cuts]
        n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        n_tokens = pa.array(totals, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), n_bytes.cast(pa.int64()), n_tokens, pc.greater(n_tokens, limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        count,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )


_LIBRARIES: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def _library(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Token counts of a list of strings, and whether the space at a boundary is kept."""
    if path not in _LIBRARIES:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _LIBRARIES[path] = (
                lambda run: [len(e) for e in model.encode_batch_fast(run, add_special_tokens=False)],
                True,
            )
        else:
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            _LIBRARIES[path] = (lambda run: [len(i) for i in pieces.encode(run, num_threads=1)], False)
    return _LIBRARIES[path]
