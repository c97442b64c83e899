"""The operators of this subpackage over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm.byte_bpe import encode_decode
from darkroom.llm.chat_format import ORACLE as CHAT_FORMAT_SQL
from darkroom.llm.chat_format import canonical_turns, digests, format_turns, read_back, records_of
from darkroom.llm.common import owned, table
from darkroom.llm.conversation_repair import ORACLE as CONVERSATION_REPAIR_SQL
from darkroom.llm.conversation_repair import repair_digests
from darkroom.llm.embedding_dedup import near_duplicates
from darkroom.llm.hard_negatives import ORACLE as HARD_NEGATIVES_SQL
from darkroom.llm.hard_negatives import hard_negatives
from darkroom.llm.language import identify
from darkroom.llm.line_dedup import ORACLE as LINE_DEDUP_SQL
from darkroom.llm.line_dedup import dedup_lines
from darkroom.llm.ngram_join import ORACLE as NGRAM_JOIN_SQL
from darkroom.llm.ngram_join import jaccard_components
from darkroom.llm.packing import pack
from darkroom.llm.paragraph_dedup import repeated_passages
from darkroom.llm.quality_rules import ORACLE as QUALITY_RULES_SQL
from darkroom.llm.quality_rules import quality_rules
from darkroom.llm.token_counts import count_tokens
from darkroom.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), keep_emptied=True)
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, anchor=vec_id % 100 == 0)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = F.lit("</s>[INST] ok [/INST]")
    planted = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(control.alias("prompt"), control.alias("response"))).alias("record")
    )
    records = records_of(table(spark, sf_dir, "conversations")).unionByName(planted)
    formatted = format_turns(canonical_turns(records)).select("conv_id", "formatted", "mask")
    return digests(read_back(formatted))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")))
    damage = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    damaged = given.filter(damage != 0).select(
        "conv_id",
        "turn",
        F.when(damage == 4, "user").otherwise(role).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(damage == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return repair_digests(damaged, given)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_toxicity": op1_toxicity,
        "op2_packing": op2_packing,
        "op3_token_counts": op3_token_counts,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_language": op5_language,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_line_dedup": op9_line_dedup,
        "op10_ngram_join": op10_ngram_join,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_chat_format": op12_chat_format,
        "op13_conversation_repair": op13_conversation_repair,
    }
    return {name: owned(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_quality_rules": QUALITY_RULES_SQL,
        "op9_line_dedup": LINE_DEDUP_SQL,
        "op10_ngram_join": NGRAM_JOIN_SQL,
        "op11_hard_negatives": HARD_NEGATIVES_SQL,
        "op12_chat_format": CHAT_FORMAT_SQL,
        "op13_conversation_repair": CONVERSATION_REPAIR_SQL,
    }
