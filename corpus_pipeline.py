"""The corpus pipeline: language, quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
docs. All but the last return the columns of docs, whatever else these hold. The first two stages judge each row by its own
text and pass it on or not, so null and repeated doc_ids change nothing; rows with a null or blank text have no language and
are rejected. Of each group of near duplicates the row with the smallest doc_id stays, one without id only where none has any;
of equal rows one stays. Very long texts are judged whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintel.llm import langid, mixing, ngramjoin, packing, quality
from lintel.llm.common import staged, table

#: Shingle words and percent of similarity of near duplicates.
SHINGLE, PERCENT = 5, 80

#: No SQL expresses the learned stages, the join's components or the packing.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told for sure, by its posterior and by how likely their words are in it."""
    return langid.confident(docs)


def graded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier selects as good and not toxic."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates."""
    return ngramjoin.one_of_each(docs, SHINGLE, PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of sources takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("quality", graded), ("near_duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
