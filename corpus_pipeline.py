"""A corpus pipeline of five stages: rules, near copies, repeated passages, the mix of sources, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomq.llm import bytebpe, minhash, mixing, quality, suffixdedup
from loomq.llm.queries import BYTE_RANKS, table
from loomq.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts have no words and are rejected, repeated rows are judged row by row."""
    return docs.where(quality.quality(F.col("text"))["kept"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id; of repeated rows, one row. Texts without words are no copies."""
    return minhash.without_near_copies(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too are cut out of the texts; null texts stay null, repeated rows lose them all."""
    out = suffixdedup.without_repeats(spark, docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it; texts without words are never taken, a null source is one of its own."""
    return mixing.mixed(spark, docs, quality=mixing.quality_weight(F.col("text")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of the ids and of what they decode to; null and empty texts have none."""
    return bytebpe.round_trip(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("byte_bpe", token_ids),
]

#: Signatures, suffix arrays, hashed keys and the tokenizer are beyond SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    tmp = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tmp.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
