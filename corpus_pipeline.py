"""From raw documents to packed training sequences, stage by stage.

Each stage takes all rows that the one before it kept, with whatever columns they have.  Cases that
all of them define: null and empty texts, ties, repeated rows, very long texts, columns of any name,
and tables without rows, which give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm.common import cut_lineage, owned, release, table
from darkroom.llm.line_dedup import dedup_lines
from darkroom.llm.ngram_join import one_of_each
from darkroom.llm.packing import pack
from darkroom.llm.paragraph_dedup import dedup_passages
from darkroom.llm.toxicity import clean


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after a stage that shortens texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic.  Null and empty texts are scored as empty; repeated rows each."""
    return clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of a line; those that lose all lines go.

    The first copy by doc_id and line stays.  Null and empty texts stay as they are; rows that
    repeat a doc_id with an equal text are one document.
    """
    return _counted(dedup_lines(docs, min_words=1, counts=False).select(*(F.col(f"`{c}`") for c in docs.columns)))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group with a similarity of 0.8 or more on five-word shingles.

    Documents without words are no copies and stay; rows that repeat a doc_id with an equal text are one.
    """
    return one_of_each(docs, length=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier place holds; those that lose all words go.

    Null and empty texts have no passages and stay; rows that repeat a doc_id with an equal text are one.
    """
    return _counted(dedup_passages(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences.  A null text is packed as an empty one; repeated rows each."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", owned(toxicity)),
    ("line_dedup", owned(line_dedup)),
    ("ngram_join", owned(ngram_join)),
    ("substring_dedup", owned(substring_dedup)),
    ("packing", owned(packing)),
]
#: The classifier and the packing order have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


@owned
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written, read again, and deleted when the next is there."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        release(before)
        before = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
