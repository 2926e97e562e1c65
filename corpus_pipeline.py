"""From raw documents to token ids: the stages of the training-data pipeline and a run of them all.

Every stage takes texts whole, however long, keeps columns of any name, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollkeeper.llm import linededup, mixing, neardup, pieces, quality
from rollkeeper.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; labels choose the cutoffs.

    Null and empty texts have no words and go. Rows that repeat are judged each, alike; a null language is a stratum of its own.
    """
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat.

    Null and empty texts stay as they are. Rows that repeat an id count as documents each, and those with the largest id keep
    the line; null ids are smaller than all others.
    """
    return linededup.dedup_lines(docs).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Null texts and those without words stay. Of rows that repeat both id and text one stays; a null id is larger than all others.
    """
    return neardup.kept_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them.

    Null and empty texts have no words; a null source is a source. Rows that repeat an id are taken alike, as places in a
    source depend on the id alone.
    """
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to.

    Null and empty texts have the begin and end ids alone; rows that repeat are encoded each.
    """
    return pieces.encoded(docs, pieces.model_bytes(spark, pieces.model_path()))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

# SentencePiece encoding is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each earlier one is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
