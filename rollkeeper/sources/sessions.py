"""Class and session metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.functions.text import strip_to_null

# What a session shows when a field was left unset.
DEFAULTS = {
    "class_name": "BCA - 2nd Year (Semester IV)",
    "subject_name": "Database Management Systems (CS-401)",
    "section": "Section A",
}


def session_metadata(sessions: DataFrame) -> DataFrame:
    """Class, subject, section and date of each session, defaults filled in."""
    others = [c for c in sessions.columns if c not in (*DEFAULTS, "session_date")]
    return sessions.select(
        *others,
        *[F.coalesce(strip_to_null(F.col(c)), F.lit(d)).alias(c) for c, d in DEFAULTS.items()],
        F.coalesce(strip_to_null(F.col("session_date")), F.date_format(F.current_date(), "yyyy-MM-dd")).alias(
            "session_date"
        ),
    )


def with_class_and_subject(sessions: DataFrame, classes: DataFrame, subjects: DataFrame) -> DataFrame:
    """Attach the class and subject dimension rows by their keys."""
    return sessions.join(
        classes.select(
            F.col("id").alias("class_id"),
            F.col("name").alias("class_label"),
            F.col("section").alias("class_section"),
        ),
        "class_id",
        "left",
    ).join(
        subjects.select(F.col("code").alias("subject_code"), F.col("name").alias("subject_label")),
        "subject_code",
        "left",
    )
