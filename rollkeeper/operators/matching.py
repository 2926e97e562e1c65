"""Record to student resolution, repeats, and students not seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.config import MATCHED, NEEDS_REVIEW, UNMATCHED, MatchConfig
from rollkeeper.functions.numeric import round2
from rollkeeper.functions.text import blank_to_null, normalize_name, strip, strip_upper
from rollkeeper.operators import lookups
from rollkeeper.operators.lookups import (
    BY_ENROLLMENT,
    BY_FUZZY,
    BY_NAME,
    BY_NORMAL_NAME,
    BY_ROLL,
    BY_ROLL_NUMBER,
    BY_STUDENT_ID,
    EXACT_STEPS,
    LAST_WINS,
    LOOKUP,
    RECORD,
)

METHOD_OF_STEP = {
    BY_STUDENT_ID: "STUDENT_ID",
    BY_ROLL: "ROLL_NUMBER",
    BY_ROLL_NUMBER: "ROLL_NUMBER",
    BY_ENROLLMENT: "ENROLLMENT_NUMBER",
    BY_NAME: "EXACT_NAME",
    BY_NORMAL_NAME: "NORMALIZED_NAME",
    BY_FUZZY: "FUZZY_NAME",
}
NOT_FOUND = "No matching student found in ERP roster."


def _per_step(step: Column, values: dict) -> Column:
    result = None
    for key, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(step == key, value) if result is None else result.when(step == key, value)
    return result


def find_exact(records: DataFrame, roster: DataFrame, steps=EXACT_STEPS) -> DataFrame:
    """Records with their best exact hit (null if none) and normalised name."""
    return records.withColumn("norm_name", normalize_name(strip(F.col("raw_name")))).join(
        lookups.best_hits(records, roster, steps), RECORD, "left"
    )


def _record_columns() -> list[Column]:
    # A blank raw id survives only on a student-id match.
    raw_id = F.when(F.col("match_step") == BY_STUDENT_ID, F.col("raw_student_id")).otherwise(
        blank_to_null(F.col("raw_student_id"))
    )
    return [
        *[F.col(c) for c in (*RECORD, "raw_name", "raw_identifier")],
        raw_id.alias("raw_student_id"),
        F.col("raw_attendance_mark"),
        F.col("status"),
        round2(F.col("confidence")).alias("ai_confidence"),
    ]


RESULT_FIELDS = [
    "match_confidence",
    "matched_student_id",
    "matched_roll_number",
    "matched_name",
    "match_method",
    "resolution",
    "review_reason",
    "candidates_count",
    "match_step",
    "candidate_key",
]


def resolve_exact(found: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Outcome of the exact hit; a key held by several students goes to review."""
    step, key, holders = F.col("hit.step"), F.col("hit.match_key"), F.col("hit.holders")
    sure = step.isin(*LAST_WINS) | (holders == 1)
    confidence = _per_step(
        step,
        {
            BY_STUDENT_ID: config.conf_student_id,
            BY_ROLL: config.conf_roll_number,
            BY_ROLL_NUMBER: config.conf_roll_number,
            BY_ENROLLMENT: config.conf_enrollment,
            BY_NAME: config.conf_exact_name,
            BY_NORMAL_NAME: config.conf_normalized_name,
        },
    )
    shared = _per_step(
        step,
        {
            BY_ROLL: F.concat(F.lit("Multiple students share roll number '"), key, F.lit("'")),
            BY_ROLL_NUMBER: F.concat(F.lit("Multiple students match numeric roll number '"), key, F.lit("'")),
            BY_NAME: "Multiple students have the exact same name.",
            BY_NORMAL_NAME: "Multiple students match this normalized name.",
        },
    )
    resolved = found.select(
        "*",
        F.when(sure, confidence).when(step.isNotNull(), config.conf_ambiguous).otherwise(0.0).alias("match_confidence"),
        F.when(sure, F.col("hit.student.student_id")).alias("matched_student_id"),
        F.when(sure, F.col("hit.student.roll_number")).alias("matched_roll_number"),
        F.when(sure, F.col("hit.student.name")).alias("matched_name"),
        F.coalesce(_per_step(step, METHOD_OF_STEP), F.lit("NONE")).alias("match_method"),
        F.when(sure, MATCHED).when(step.isNotNull(), NEEDS_REVIEW).otherwise(UNMATCHED).alias("resolution"),
        F.when(step.isNull(), NOT_FOUND).when(~sure, shared).alias("review_reason"),
        F.when(sure | step.isNull(), F.lit(0)).otherwise(holders).cast("bigint").alias("candidates_count"),
        F.coalesce(step, F.lit(0)).alias("match_step"),
        F.when(~sure, key).alias("candidate_key"),
    )
    return resolved.select(*_record_columns(), *RESULT_FIELDS)


def resolve_fuzzy(open_records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of the name decision for records no exact step found."""
    hit = F.col("student").isNotNull()
    joined = open_records.join(decisions, ["scope_id", "norm_name"], "left")
    resolved = joined.select(
        *[c for c in joined.columns if c not in (*RESULT_FIELDS, "student")],
        F.coalesce(F.col("match_confidence"), F.lit(0.0)).alias("match_confidence"),
        F.col("student.student_id").alias("matched_student_id"),
        F.col("student.roll_number").alias("matched_roll_number"),
        F.col("student.name").alias("matched_name"),
        F.when(hit, METHOD_OF_STEP[BY_FUZZY]).otherwise("NONE").alias("match_method"),
        F.coalesce(F.col("resolution"), F.lit(UNMATCHED)).alias("resolution"),
        F.when(hit, F.col("review_reason")).otherwise(NOT_FOUND).alias("review_reason"),
        F.coalesce(F.col("candidates_count"), F.lit(0)).cast("bigint").alias("candidates_count"),
        F.when(hit, BY_FUZZY).otherwise(0).alias("match_step"),
        F.when(hit, F.col("norm_name")).alias("candidate_key"),
    )
    return resolved.select(*_record_columns(), *RESULT_FIELDS)


def resolve_one_step(records: DataFrame, roster: DataFrame, step: int, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Outcome of a single exact step for the records it finds."""
    found = find_exact(records, roster, (step,)).filter(F.col("hit").isNotNull())
    return resolve_exact(found, config)


def student_key(student_id: Column) -> Column:
    return blank_to_null(strip_upper(student_id))


def first_seen(resolved: DataFrame) -> DataFrame:
    """The first record that named a student, per scope and student.

    A pre-aggregated minimum instead of a window, so a student who fills a third
    of all records never lands in one task.
    """
    first = F.min(F.struct("rec_seq", "status")).alias("first")
    return (
        resolved.select("scope_id", student_key(F.col("matched_student_id")).alias("student_key"), "rec_seq", "status")
        .filter(F.col("student_key").isNotNull())
        .groupBy("scope_id", "student_key")
        .agg(first)
        .select("scope_id", "student_key", F.col("first.rec_seq").alias("first_seq"), F.col("first.status").alias("first_status"))
    )


def flag_repeats(resolved: DataFrame, firsts: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Final outcome: unclear marks, then repeats and conflicts, all sent to review."""
    # Records without a student get a key of their own, so they spread evenly.
    own_key = F.concat(F.lit("\x00"), F.col("rec_seq").cast("string"))
    keyed = resolved.withColumn("student_key", F.coalesce(student_key(F.col("matched_student_id")), own_key))
    joined = keyed.join(firsts, ["scope_id", "student_key"], "left")

    unclear = (F.col("ai_confidence") < config.review_below) & (F.col("resolution") == MATCHED)
    repeat = F.coalesce(F.col("rec_seq") > F.col("first_seq"), F.lit(False))
    conflict = repeat & (F.col("status") != F.col("first_status"))
    flagged = joined.select(
        "*", unclear.alias("is_unclear"), repeat.alias("is_duplicate"), conflict.alias("is_conflict")
    )
    student = lambda: [F.col("matched_student_id"), F.lit("' ("), F.coalesce(F.col("matched_name"), F.lit("None"))]
    reason = (
        F.when(
            F.col("is_conflict"),
            F.concat(
                F.lit("Conflicting attendance records detected for student ID '"),
                *student(),
                F.lit("): "),
                F.col("first_status"),
                F.lit(" vs "),
                F.col("status"),
                F.lit(". Requires teacher review."),
            ),
        )
        .when(
            F.col("is_duplicate"),
            F.concat(
                F.lit("Duplicate AI record: Student ID '"),
                *student(),
                F.lit(") appeared more than once in AI results."),
            ),
        )
        .when(F.col("is_unclear"), unclear_reason(F.col("ai_confidence")))
        .otherwise(F.col("review_reason"))
    )
    review = F.col("is_unclear") | F.col("is_duplicate")
    changed = {
        "resolution": F.when(review, NEEDS_REVIEW).otherwise(F.col("resolution")),
        "review_reason": reason,
    }
    kept = [c for c in resolved.columns]
    return flagged.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in kept],
        "is_duplicate",
        "is_conflict",
        "is_unclear",
        "first_status",
    )


def unclear_reason(confidence: Column) -> Column:
    return F.format_string(
        "Unclear physical attendance mark on sheet (AI confidence: %.2f). Requires teacher review.", confidence
    )


def missing_students(roster: DataFrame, firsts: DataFrame) -> DataFrame:
    """Roster rows no record named. Read them ordered by ``roll_order, student_id``."""
    seen = firsts.select("scope_id", "student_key")
    return (
        roster.withColumn("student_key", strip_upper(F.col("student_id")))
        .join(seen, ["scope_id", "student_key"], "left_anti")
        .drop("student_key")
        .withColumn("roll_order", F.coalesce(F.col("roll_number"), F.lit("")))
    )


def candidate_rows(results: DataFrame, roster: DataFrame, fuzzy: DataFrame | None) -> DataFrame:
    """The candidates behind every shared key, one row per student.

    Kept beside the results and reached by ``match_step, candidate_key``: records
    with the same key share one list, which may be as long as the class.
    """
    shared = results.filter(F.col("candidate_key").isNotNull() & (F.col("match_step") != BY_FUZZY))
    wanted = shared.select(
        "scope_id", F.col("match_step").alias("step"), F.col("candidate_key").alias("match_key")
    ).distinct()
    exact = (
        lookups.roster_keys(roster)
        .join(wanted, LOOKUP, "left_semi")
        .select(
            "scope_id",
            F.col("step").alias("match_step"),
            F.col("match_key").alias("candidate_key"),
            F.col("roster_seq").cast("bigint").alias("position"),
            "student_id",
            "roll_number",
            "name",
            F.lit(None).cast("double").alias("similarity"),
        )
    )
    if fuzzy is None:
        return exact
    return exact.unionByName(
        fuzzy.select(
            "scope_id",
            F.lit(BY_FUZZY).alias("match_step"),
            F.col("norm_name").alias("candidate_key"),
            F.col("rank").cast("bigint").alias("position"),
            "student_id",
            "roll_number",
            "name",
            round2(F.col("score")).alias("similarity"),
        )
    )
