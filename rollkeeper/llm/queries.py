"""Every operator of this folder over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeeper.llm import disclosure, linededup, mixing, neardup, negatives, neighbours, pages, pieces, quality, ranked, secrets, suffixes, toxicity
from rollkeeper.llm.common import table

c = F.col


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extracted(table(spark, folder, "pages"))


def op2_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.findings(table(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    rows = quality.judged(docs, table(spark, folder, "labels"), carried=("doc_id",))
    return rows.select("_row.doc_id", *quality.COUNTS, "base_failed", "kept")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, folder, "documents")).drop("kept")


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = neardup.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    sha = F.sha2(F.coalesce(c("row.text"), F.lit("")).cast("binary"), 256)
    return rows.select("row.doc_id", "n_lines", "n_dropped", sha.alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(table(spark, folder, "documents"), pieces.model_bytes(spark, pieces.model_path()), ids=False)


def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mix(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.sanitise(table(spark, folder, "documents"), text=False)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"), label=negatives.moved_label())


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_secret_scans": op2_secret_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_source_mixing": op10_source_mixing,
    "op11_pii": op11_pii,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
}
