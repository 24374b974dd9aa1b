"""A training corpus from raw documents, stage by stage.

Every stage takes all documents its predecessor kept; each is written as Parquet in the shared
folder before the next one reads it, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, langid, lines, mixing, simhash
from tallyspark.llm.common import documents, workers_ready
from tallyspark.plans.shared import written

VOCABULARY = os.path.join(os.environ.get("TALLY_TOKENIZERS", "/opt/tokenizers"), "word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, among them null and empty texts, go; `lang` becomes the
    identified language (the first in order on a tie). Repeated rows are judged alike; an empty table
    stays empty, other columns stay as they are."""
    workers_ready(spark)
    return langid.keep_identified(docs, langid.train(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal lines the first one in the corpus stays; a line also goes if it is within one edit for
    every 20 code points, two at most, of an earlier line that stays. A null text stays null, a text
    may become empty; rows that repeat an id lose the same lines."""
    return lines.line_dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (4-word shingles, links at 4 or fewer differing bits, the operator's
    contract) the smallest id stays, with all its rows. Copies always meet; of near copies only those
    whose fingerprints are that near: 4 of 48 pairs at 5-word Jaccard 0.8 on sf0.1. Empty and null
    texts share the fingerprint zero; rows with a null id stay."""
    workers_ready(spark)
    return simhash.simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions: documents are repeated or sampled. Null sources are one
    source; ties go by the id's hash, then the id. An empty table stays empty."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids decode to; a null or empty text
    has no ids. Repeated rows each get a row."""
    workers_ready(spark)
    return bpe.encode_documents(docs, VOCABULARY).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language models and fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
