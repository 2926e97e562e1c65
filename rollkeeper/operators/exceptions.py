"""Exception rows and the match summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.config import MATCHED, NEEDS_REVIEW, UNMATCHED
from rollkeeper.functions.text import blank_to_null
from rollkeeper.operators.matching import unclear_reason

# Read exceptions ordered by these: records first, then missing students.
ORDER = ["scope_id", "phase", "seq", "nth"]


def _entry(condition: Column, kind: str, student_id, name, message, details: dict[str, Column]) -> Column:
    pairs = [x for key, value in details.items() for x in (F.lit(key), value.cast("string"))]
    return F.when(
        condition,
        F.struct(
            F.lit(kind).alias("type"),
            student_id.alias("student_id"),
            name.alias("name"),
            message.alias("message"),
            F.create_map(*pairs).alias("details"),
        ),
    )


def record_exceptions(results: DataFrame) -> DataFrame:
    """Exceptions of each record, in the order the rules raise them."""
    c = F.col
    nothing = F.lit(None).cast("string")
    shown = F.coalesce(blank_to_null(c("matched_name")), c("raw_name"))
    raw = {"raw_name": c("raw_name"), "raw_identifier": c("raw_identifier")}
    entries = F.array(
        _entry(
            c("is_unclear"),
            "UNCLEAR_ATTENDANCE_MARK",
            c("matched_student_id"),
            shown,
            unclear_reason(c("ai_confidence")),
            {"ai_confidence": c("ai_confidence"), "detected_status": c("status")},
        ),
        _entry(
            c("is_conflict"),
            "CONFLICTING_ATTENDANCE_DETECTED",
            c("matched_student_id"),
            c("matched_name"),
            c("review_reason"),
            {"previous_status": c("first_status"), "current_status": c("status")},
        ),
        _entry(
            c("is_duplicate") & ~c("is_conflict"),
            "DUPLICATE_DETECTED",
            c("matched_student_id"),
            c("matched_name"),
            c("review_reason"),
            raw,
        ),
        _entry(
            (c("resolution") == NEEDS_REVIEW) & ~c("is_duplicate"),
            "AMBIGUOUS_MATCH",
            c("matched_student_id"),
            shown,
            F.coalesce(blank_to_null(c("review_reason")), F.lit("Ambiguous match requires teacher review.")),
            {"candidates_count": c("candidates_count")},
        ),
        _entry(
            (c("resolution") == UNMATCHED) & ~c("is_duplicate"),
            "UNMATCHED_STUDENT",
            nothing,
            c("raw_name"),
            F.concat(
                F.lit("No matching ERP student found for AI record: '"),
                F.coalesce(blank_to_null(c("raw_name")), c("raw_identifier"), F.lit("None")),
                F.lit("'"),
            ),
            raw,
        ),
    )
    return results.select(
        "scope_id", c("rec_seq").cast("bigint").alias("seq"), F.posexplode(F.filter(entries, lambda e: e.isNotNull())).alias("nth", "e")
    ).select("scope_id", F.lit(0).alias("phase"), "seq", "nth", "e.*")


def missing_exceptions(missing: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("Student "),
        F.col("student_id"),
        F.lit(" ("),
        F.col("name"),
        F.lit(") was not detected in AI results. Will NOT be marked absent automatically."),
    )
    return missing.select(
        "scope_id",
        F.lit(1).alias("phase"),
        F.col("roster_seq").cast("bigint").alias("seq"),
        F.lit(0).alias("nth"),
        F.lit("MISSING_ERP_STUDENT").alias("type"),
        "student_id",
        "name",
        message.alias("message"),
        F.lit(None).cast("map<string,string>").alias("details"),
    )


def all_exceptions(results: DataFrame, missing: DataFrame) -> DataFrame:
    return record_exceptions(results).unionByName(missing_exceptions(missing))


def match_summary(results: DataFrame, roster: DataFrame, missing: DataFrame) -> DataFrame:
    """Tallies per scope; a scope with only records or only a roster counts too."""
    one, zero = F.lit(1), F.lit(0)
    names = [
        "total_ai_records", "matched", "needs_review", "unmatched", "duplicates",
        "total_erp_students", "missing_erp_students_count",
    ]

    def part(df: DataFrame, **flags) -> DataFrame:
        return df.select("scope_id", *[flags.get(n, zero).cast("bigint").alias(n) for n in names])

    is_state = lambda state: F.when(F.col("resolution") == state, 1).otherwise(0)
    parts = (
        part(
            results,
            total_ai_records=one,
            matched=is_state(MATCHED),
            needs_review=is_state(NEEDS_REVIEW),
            unmatched=is_state(UNMATCHED),
            duplicates=F.col("is_duplicate").cast("int"),
        )
        .unionAll(part(roster, total_erp_students=one))
        .unionAll(part(missing, missing_erp_students_count=one))
    )
    return parts.groupBy("scope_id").agg(*[F.sum(n).alias(n) for n in names])
