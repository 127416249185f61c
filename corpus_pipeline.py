"""Corpus pipeline: quality rules, near duplicates, repeated passages, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``docs``; the last returns the packed pieces. Rows with a
null id, repeated rows and extra columns pass through every stage; null and empty texts
fail the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equityspark.llm import jaccard, packing, pii, quality, substring
from equityspark.llm.common import table, written
from equityspark.llm.queries import PII_KEY


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that neither the base rule nor the learned list rejects."""
    own = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    return quality.judge(own, table(spark, sf_dir, "labels")).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by shingle similarity: the one of smallest id.

    A null id is replaced by a key made from the text, behind all ids. Of rows that repeat
    an id and its text one stays; texts without words are linked with nothing and stay.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))
    own = docs.select(F.struct("*").alias("_row"), key.alias("doc_id"), "text")
    groups = jaccard.join(own)
    stay = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.max("n_shingles").alias("_n"))
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    kept = own.join(stay, "doc_id").withColumn("_again", F.when(F.col("_n") > 0, F.row_number().over(again)).otherwise(F.lit(1)))
    return kept.where("_again = 1").select("_row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of 13-word windows that an earlier document has; documents with nothing left go.

    Documents without such a window keep their text as it is.
    """
    own = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    cut = substring.repeats(own).where((F.size("spans") == 0) | (F.col("kept") != ""))
    text = F.when(F.size("spans") == 0, F.col("_row.text")).otherwise(F.col("kept"))
    return _with_length(cut.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates."""
    own = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "text")
    new = pii.replace(own, PII_KEY)
    return _with_length(new.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token pieces of all documents into sequences of 2,048."""
    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(written(parts, "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("pii_surrogates", pii_surrogates),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # the learned rules, the surrogates and the tokens are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
