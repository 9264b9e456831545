"""A corpus pipeline of five operators: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's result into the shared folder as Parquet and reads it back for the next.

Defined results: stages read the columns of ``documents`` only, so further columns of a table never clash; null texts and
texts without words fail the first stage; empty tables stay empty; rows with a null id are kept and dropped by
their text like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, pii, quality_rules, sentencepiece_codec, simhash
from lexweave.llm.common import materialise, table
from lexweave.llm.queries import model_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_per_group(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    found = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where("n_hit = 0").select(*COLUMNS)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` follows the new text."""
    return pii.replace(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document."""
    return sentencepiece_codec.digests(docs.select(*COLUMNS), model_path())


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("PII", hide_persons),
    ("SentencePiece encoding and decoding", to_tokens),
]

ORACLE_SQL = None  # SQL has no XXH64 and no piece merging


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs
