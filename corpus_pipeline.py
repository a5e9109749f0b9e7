"""A corpus from raw documents to token ids, in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of ``documents``. Each works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import alike, mixing, pieces, pii, toxicity
from trellis.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees call toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of at least 0.8, or fingerprints within 2 bits) the document with the smallest id stays."""
    return alike.one_of_each_group(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to the names of their kinds."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that all sources weigh the same, and dealt out at random."""
    return mixing.mix(docs, numbered=False)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the hashes of the ids and of what they decode to."""
    return pieces.encode(docs, "doc_id", "lang", "source", with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("sentencepiece", to_tokens),
]
#: SQL has no boosted trees, XXH64 or merges; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
