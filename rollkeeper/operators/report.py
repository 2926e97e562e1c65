"""Review report and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkeeper.config import NEEDS_REVIEW, PRESENT
from rollkeeper.functions.display import exception_label, resolution_label
from rollkeeper.functions.numeric import percent
from rollkeeper.functions.text import blank_to_null, strip

PREVIEW = 3


def _shown(*columns: str | Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(F.col(c)) if isinstance(c, str) else c for c in columns])


def _tagged(value: Column) -> Column:
    return F.when(value.startswith("#"), value).otherwise(F.concat(F.lit("#"), value))


def _mark_and_status() -> list[Column]:
    short = F.when(F.col("status") == PRESENT, "P").otherwise("A")
    present = F.upper(F.coalesce(F.col("status"), F.lit("ABSENT"))) == PRESENT
    return [
        _shown("raw_attendance_mark", short).alias("mark"),
        F.when(present, "PRESENT").otherwise("ABSENT").alias("status_label"),
    ]


def _numbered(name: str) -> Column:
    return F.concat(F.lit("#"), blank_to_null(F.col(name)))


def review_rows(results: DataFrame) -> DataFrame:
    """One line per result of a matched sheet."""
    differs = F.col("matched_name") != F.col("raw_name")
    read_as = F.when(
        blank_to_null(F.col("matched_name")).isNotNull() & blank_to_null(F.col("raw_name")).isNotNull() & differs,
        F.concat(F.lit('OCR: "'), F.col("raw_name"), F.lit('"')),
    )
    return results.select(
        "scope_id",
        "rec_seq",
        _tagged(_shown("matched_roll_number", "raw_identifier", F.lit("-"))).alias("roll"),
        _shown("matched_name", "raw_name", F.lit("Unknown Student")).alias("student"),
        F.coalesce(read_as, _numbered("matched_student_id"), _numbered("raw_student_id"), F.lit("")).alias("sub_line"),
        *_mark_and_status(),
        resolution_label(F.col("resolution")).alias("match_label"),
        percent(F.col("ai_confidence")).alias("ai_percent"),
        percent(F.col("match_confidence")).alias("match_percent"),
    )


def sheet_only_rows(records: DataFrame, roster: DataFrame) -> DataFrame:
    """Lines for scopes without any roster: the reading confidence instead of a match."""
    alone = records.join(roster.select("scope_id").distinct(), "scope_id", "left_anti")
    return alone.select(
        "scope_id",
        "rec_seq",
        _tagged(_shown("raw_identifier", F.lit("-"))).alias("roll"),
        _shown("raw_name", F.lit("Unknown")).alias("student"),
        F.coalesce(_numbered("raw_student_id"), F.lit("")).alias("sub_line"),
        *_mark_and_status(),
        percent(F.col("confidence")).alias("confidence_percent"),
    )


def exception_rows(exceptions: DataFrame) -> DataFrame:
    return exceptions.select("scope_id", "phase", "seq", "nth", exception_label(F.col("type")).alias("label"), "message")


def candidate_previews(candidates: DataFrame) -> DataFrame:
    """The first three candidates behind every shared key, as one list of lines.

    The rank limit also runs before the shuffle, so a key shared by a whole class
    sends three rows per task.
    """
    order = Window.partitionBy("scope_id", "match_step", "candidate_key").orderBy("position")
    similar = F.when(
        F.col("similarity") > 0, F.concat(F.lit(" ("), percent(F.col("similarity")).cast("string"), F.lit("%)"))
    )
    line = F.concat(F.col("student_id"), F.lit(" — "), F.col("name"), F.coalesce(similar, F.lit("")))
    return (
        candidates.withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= PREVIEW)
        .groupBy("scope_id", "match_step", "candidate_key")
        .agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("lines"))
        .select(
            "scope_id", "match_step", "candidate_key", F.array_join(F.transform("lines", lambda x: x["line"]), "; ").alias("preview")
        )
    )


def review_previews(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate lines for the results that need review."""
    open_results = results.filter((F.col("resolution") == NEEDS_REVIEW) & F.col("candidate_key").isNotNull())
    return open_results.select("scope_id", "rec_seq", "match_step", "candidate_key").join(
        candidate_previews(candidates), ["scope_id", "match_step", "candidate_key"]
    )


def search_students(rows: DataFrame, query: str) -> DataFrame:
    """Students whose name, roll number or id contains the query, ignoring case."""
    wanted = F.lower(strip(F.lit(query)))
    hit = None
    for column in ("name", "roll_number", "student_id"):
        found = F.coalesce(F.contains(F.lower(F.col(column)), wanted), F.lit(False))
        hit = found if hit is None else hit | found
    return rows.filter(hit)


def roster_listing(roster: DataFrame, query: str = "") -> DataFrame:
    """Roster as listed, read ordered by ``scope_id, roster_seq``."""
    return search_students(roster, query).select(
        "scope_id", "roster_seq", "roll_number", "student_id", "name", "gender", "email",
        F.lit("Enrolled / Active").alias("enrolment"),
    )


def subject_listing(subjects: DataFrame) -> DataFrame:
    return subjects.select(
        "code", "name", F.concat(F.col("credits").cast("string"), F.lit(" Credits")).alias("credits"), "type"
    )


def history_listing(history: DataFrame) -> DataFrame:
    """Session history, newest first."""
    return history.orderBy(F.desc("session_date"), F.desc("session_id"))
