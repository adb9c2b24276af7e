"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutledger.llm import common as cm, jaccard_join, langid, packing, secrets, suffix_dedup

#: A text is rejected if it has no letter, or if no language gets this share of its positions.
LEAST_SCORE = 0.3
#: Bytes of a passage that is cut where it repeats, and of the identifiers it is found by. In the texts of sf0.01
#: all 319,045 passages of 51 words take 152 bytes or more (0.7 % of them under 250), so each one of over 50 words is reached.
PASSAGE, PASSAGE_GRAM = 150, 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose language can't be told."""
    return langid.told(docs, langid.fit(docs), LEAST_SCORE)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of over 50 words, by their bytes, that occur more than once out of the texts."""
    return suffix_dedup.strip(docs, length=PASSAGE, gram=PASSAGE_GRAM)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of the texts into sequences."""
    return packing.pack(docs, cm.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id), ("ngram_jaccard_join", ngram_jaccard_join), ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans), ("packing", pack_sequences),
]
#: SQL can express neither the network nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = cm.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = cm.scratch_table(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
