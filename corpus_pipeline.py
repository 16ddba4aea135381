"""The corpus pipeline: raw documents to packed training batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.

Edge cases: null and empty texts fail the quality rules; rows of one id and one
text are copies, of which one stays; rows of one id with different texts are
one document to near dedup, and all of them stay if it does; a null id takes no part in near
dedup and stays; null sources and languages are values that no target lists;
texts of any length are cleaned, compared, weighed and packed whole; extra
columns, whatever their names, are kept until packing, whose rows have its own
columns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limber.llm import exact_dedup, mixing, near_dedup, packing, quality, token_counts
from limber.llm.common import settled, table, written_so_far


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: failing lines go, and documents that lose too much."""
    return quality.clean_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one row of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are sampled so that sources, languages and topics meet their target weights."""
    return mixing.sample_mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: spans of all documents, measured in tokens, in batches of like length."""
    return packing.pack(token_counts.token_counts(docs))


STAGES = [
    ("quality rules", clean),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Near-dedup, mixing and packing cannot be said in SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what they wrote on the way is deleted as soon as the next stage is written."""
    docs, since = table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "_"), since)
    return docs
