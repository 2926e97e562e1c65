"""Counts per sheet, scope and session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.config import ABSENT, LATE, PRESENT
from rollkeeper.functions.display import display_date


def attendance_summary(records: DataFrame, key: str = "sheet_id") -> DataFrame:
    return records.groupBy(key).agg(
        F.count("*").alias("total_detected"),
        F.count_if(F.col("status") == PRESENT).alias("present"),
        F.count_if(F.col("status") == ABSENT).alias("absent"),
    )


def roster_tally(rows: DataFrame) -> DataFrame:
    """Statuses other than PRESENT, ABSENT and LATE count as unmarked."""
    marked = F.coalesce(F.col("status").isin(PRESENT, ABSENT, LATE), F.lit(False))
    return rows.groupBy("scope_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == PRESENT).alias("present"),
        F.count_if(F.col("status") == ABSENT).alias("absent"),
        F.count_if(F.col("status") == LATE).alias("late"),
        F.count_if(~marked).alias("unmarked"),
    )


def report_tally(results: DataFrame, exceptions: DataFrame) -> DataFrame:
    """PRESENT against everything else, and the number of exceptions."""
    present = (F.upper(F.coalesce(F.col("status"), F.lit(ABSENT))) == PRESENT).cast("bigint")
    zero = F.lit(0).cast("bigint")
    parts = results.select(
        "scope_id", F.lit(1).alias("records"), present.alias("present"), (1 - present).alias("absent"), zero.alias("exceptions")
    ).unionAll(exceptions.select("scope_id", zero, zero, zero, F.lit(1).cast("bigint")))
    names = ["records", "present", "absent", "exceptions"]
    return parts.groupBy("scope_id").agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def apply_issues(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scopes that were to be applied to, with an issue where the roster has no rows."""
    filled = rows.select("scope_id").distinct().withColumn("filled", F.lit(True))
    issue = F.when(F.col("filled").isNull(), F.array(F.lit("No student rows found in table."))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        scopes.select("scope_id")
        .distinct()
        .join(filled, "scope_id", "left")
        .select("scope_id", F.col("filled").isNotNull().alias("is_valid"), issue.alias("issues"))
    )


def session_submissions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """One history row per session of a scope: its tallies and its metadata.

    ``sessions`` has ``scope_id, session_id, session_date`` and any further columns
    to carry. A scope without roster rows submits zeros.
    """
    counts = ["total", "present", "absent", "late", "unmarked"]
    warning = F.when(
        F.col("unmarked") > 0,
        F.concat(
            F.lit("Caution: "),
            F.col("unmarked").cast("string"),
            F.lit(" student(s) remain Unmarked. Are you sure you want to proceed?"),
        ),
    )
    return (
        sessions.join(roster_tally(rows), "scope_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts})
        .withColumnRenamed("total", "total_students")
        .withColumns(
            {
                "date_formatted": display_date(F.col("session_date")),
                "submit_status": F.lit("Submitted"),
                "warning": warning,
            }
        )
    )
