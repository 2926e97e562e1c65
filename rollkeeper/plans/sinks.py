"""Writing extraction, match and session results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeeper.config import MatchConfig
from rollkeeper.operators import exceptions, matching, tallies
from rollkeeper.plans.reconcile import Reconciliation, resolve


def write_extraction(records: DataFrame, folder: str) -> None:
    """Records, then the summary computed from the written records."""
    spark = records.sparkSession
    records.write.mode("overwrite").parquet(f"{folder}/records")
    stored = spark.read.parquet(f"{folder}/records")
    tallies.attendance_summary(stored).write.mode("overwrite").parquet(f"{folder}/summary")


def write_match(
    records: DataFrame, roster: DataFrame, folder: str, config: MatchConfig = MatchConfig()
) -> Reconciliation:
    """Run the match and write its five tables; each builds on the written results.

    Scopes are classes, of which there may be billions, so they are no partition
    folders: the tables are clustered by scope inside their files instead.
    """
    spark = records.sparkSession
    resolved, candidates = resolve(records, roster, config)
    final = matching.flag_repeats(resolved, matching.first_seen(resolved), config)
    final.sortWithinPartitions("scope_id", "rec_seq").write.mode("overwrite").parquet(f"{folder}/results")
    results = spark.read.parquet(f"{folder}/results")
    missing = matching.missing_students(roster, matching.first_seen(results))
    missing.write.mode("overwrite").parquet(f"{folder}/missing")
    missing = spark.read.parquet(f"{folder}/missing")
    exceptions.all_exceptions(results, missing).write.mode("overwrite").parquet(f"{folder}/exceptions")
    exceptions.match_summary(results, roster, missing).write.mode("overwrite").parquet(f"{folder}/summary")
    matching.candidate_rows(results, roster, candidates).write.mode("overwrite").parquet(f"{folder}/candidates")
    return read_match(spark, folder)


def read_match(spark: SparkSession, folder: str) -> Reconciliation:
    names = ("results", "candidates", "missing", "exceptions", "summary")
    return Reconciliation(**{n: spark.read.parquet(f"{folder}/{n}") for n in names})


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """One JSON document per row, beside its keys."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("document"))
