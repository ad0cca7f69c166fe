"""The corpus pipeline: documents without unknown languages, toxic texts and copies, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs.  All but the last return the columns of documents, whatever other columns these have.

Defined cases are those of the operators: null and empty texts have no letter and go with the first stage; an
empty table stays empty through all stages; of repeated rows one stays after exact dedup.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sightings.llm.common import documents, prepare
from sightings.llm.exact_dedup import drop_copies
from sightings.llm.language_id import drop_unknown
from sightings.llm.packing import pack_documents
from sightings.llm.simhash import drop_near_copies
from sightings.llm.toxicity import drop_toxic
from sightings.session import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without a letter, and so without a language, go."""
    prepare(spark)
    return drop_unknown(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that score a half or more go."""
    return drop_toxic(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of equal texts stays."""
    return drop_copies(prepare(spark), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near copies stays; four-word shingles, fingerprints within four bits."""
    prepare(spark)
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of all documents with their place in the packed sequences."""
    prepare(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

# Two models, fingerprints' components and a tokenizer: not for SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
