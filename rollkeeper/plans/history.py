"""Session history that grows by whole submissions, each of them exactly once.

A batch is written to a folder of its own and counts only once a row of the commit table names it. Of several attempts
at one submission id the first that committed counts, so an append may be repeated after any failure, and readers
never see a part of a batch. The commit table is a table like any other: reading history is a join with it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "submission_id string, attempt string, committed_at bigint"


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMITS).parquet(f"{folder}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """``submission_id, attempt`` of the attempts that count."""
    first = F.min(F.struct("committed_at", "attempt")).alias("first")
    return _commits(spark, folder).groupBy("submission_id").agg(first).select("submission_id", "first.attempt")


def append_history(submissions: DataFrame, folder: str, submission_id: str) -> bool:
    """Append the rows of one submission; whether this call did. A submission that is there already stays as it is."""
    spark = submissions.sparkSession
    if not _commits(spark, folder).filter(F.col("submission_id") == submission_id).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    submissions.withColumn("submission_id", F.lit(submission_id)).write.parquet(f"{folder}/rows/attempt={attempt}")
    commit = spark.createDataFrame([(submission_id, attempt, time.time_ns())], _COMMITS)
    commit.coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    # Another writer of the same submission may have come first.
    return committed(spark, folder).filter(F.col("attempt") == attempt).count() == 1


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all committed submissions, with their ``submission_id``."""
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return rows.join(committed(spark, folder).select("attempt"), "attempt", "left_semi").drop("attempt")
