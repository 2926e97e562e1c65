"""Writing approved statuses into roster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.config import ABSENT, LATE, PRESENT, UNMARKED
from rollkeeper.functions.text import blank_to_null, strip, strip_leading_zeros, strip_upper

RECORD = ["scope_id", "rec_seq"]
ROW = ["scope_id", "roster_seq"]
NOT_FOUND = "STUDENT_NOT_FOUND"
NO_CONTROL = "ATTENDANCE_CONTROL_NOT_FOUND"
SHEET_STATUSES = (PRESENT, ABSENT, UNMARKED)
ROSTER_STATUSES = (PRESENT, ABSENT, LATE, UNMARKED)


def guarded_status(status: Column, allowed=SHEET_STATUSES) -> Column:
    """Upper-cased status if allowed, else UNMARKED."""
    upper = F.upper(F.coalesce(blank_to_null(status), F.lit(UNMARKED)))
    return F.when(upper.isin(*allowed), upper).otherwise(UNMARKED)


def _entries(*pairs: tuple[int, int, Column]) -> Column:
    """Lookup entries: the order they are tried in, the map they use, the key."""
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(turn).alias("turn"), F.lit(table).alias("map"), blank_to_null(key).alias("key"))
                for turn, table, key in pairs
            ]
        )
    )


def apply_targets(rows: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved records with the roster row each goes to, and its outcome.

    Tried in turn: id, roll number, roll number without leading zeros, name. All
    go through one join of long-form keys; of rows sharing a key the last one wins.
    """
    locked = F.col("locked") if "locked" in rows.columns else F.lit(False)
    roll = F.upper("roll_number")
    index = (
        rows.select(
            *ROW,
            locked.alias("locked"),
            _entries(
                (1, 1, F.upper("student_id")),
                (2, 2, roll),
                (2, 2, strip_leading_zeros(roll)),
                (4, 3, F.lower("name")),
            ).alias("e"),
        )
        .filter(F.col("e.key").isNotNull())
        .groupBy("scope_id", F.col("e.map").alias("map"), F.col("e.key").alias("key"))
        .agg(F.max(F.struct("roster_seq", "locked")).alias("row"))
    )
    wanted = strip_upper(F.col("roll_number"))
    probes = (
        approved.select(
            *RECORD,
            _entries(
                (1, 1, strip_upper(F.col("student_id"))),
                (2, 2, wanted),
                (3, 2, strip_leading_zeros(wanted)),
                (4, 3, F.lower(strip(F.col("name")))),
            ).alias("e"),
        )
        .select(*RECORD, "e.*")
        .filter(F.col("key").isNotNull())
    )
    best = (
        probes.join(index, ["scope_id", "map", "key"])
        .groupBy(*RECORD)
        .agg(F.min_by(F.struct("row.roster_seq", "row.locked"), F.col("turn")).alias("row"))
        .select(*RECORD, "row.roster_seq", "row.locked")
    )
    reason = F.when(F.col("roster_seq").isNull(), NOT_FOUND).when(F.col("locked"), NO_CONTROL)
    return approved.join(best, RECORD, "left").select(
        *approved.columns, "roster_seq", guarded_status(F.col("status")).alias("final_status"), reason.alias("reason")
    )


def apply_targets_by_id(rows: DataFrame, approved: DataFrame, count_unknown: bool = False) -> DataFrame:
    """The roster application's own rule: exact id only, LATE allowed, other statuses skipped.

    With ``count_unknown`` an id the roster lacks still counts as applied.
    """
    last = rows.groupBy("scope_id", "student_id").agg(F.max("roster_seq").alias("roster_seq"))
    status = F.upper(F.coalesce(F.col("status"), F.lit("")))
    valid = status.isin(*ROSTER_STATUSES) & blank_to_null(F.col("student_id")).isNotNull()
    found = approved.join(last, ["scope_id", "student_id"], "left")
    reason = F.when(~F.coalesce(valid, F.lit(False)), "SKIPPED")
    if not count_unknown:
        reason = reason.when(F.col("roster_seq").isNull(), NOT_FOUND)
    return found.select(*approved.columns, "roster_seq", status.alias("final_status"), reason.alias("reason"))


def apply_summary(targets: DataFrame) -> DataFrame:
    reason = F.col("reason")
    return targets.groupBy("scope_id").agg(
        F.count("*").alias("total"),
        F.count_if(reason.isNull()).alias("applied"),
        F.count_if(reason == NOT_FOUND).alias("unmatched"),
        F.count_if(reason == NO_CONTROL).alias("failed"),
    )


def updated_rows(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """A new version of the roster table: the last record per row wins.

    Remarks change only where a record brings a non-empty one.
    """
    remark = F.when(blank_to_null(F.col("remarks")).isNotNull(), F.col("rec_seq"))
    changes = (
        targets.filter(F.col("reason").isNull() & F.col("roster_seq").isNotNull())
        .groupBy(*ROW)
        .agg(
            F.max_by("final_status", "rec_seq").alias("new_status"),
            F.max_by("remarks", remark).alias("new_remarks"),
        )
    )
    kept = [c for c in rows.columns if c not in ("status", "remarks", "modified")]
    before = F.col("modified") if "modified" in rows.columns else F.lit(False)
    return rows.join(changes, ROW, "left").select(
        *kept,
        F.coalesce("new_status", "status").alias("status"),
        F.coalesce("new_remarks", "remarks").alias("remarks"),
        (before | F.col("new_status").isNotNull()).alias("modified"),
    )


def change_statuses(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Single edits by exact id; an invalid status becomes UNMARKED, unknown ids are ignored."""
    edits = changes.select(
        "scope_id",
        "student_id",
        "rec_seq",
        F.when(F.col("status").isin(*ROSTER_STATUSES), F.col("status")).otherwise(UNMARKED).alias("new_status"),
    )
    last = edits.groupBy("scope_id", "student_id").agg(F.max_by("new_status", "rec_seq").alias("new_status"))
    kept = [c for c in rows.columns if c not in ("status", "modified")]
    before = F.col("modified") if "modified" in rows.columns else F.lit(False)
    return rows.join(last, ["scope_id", "student_id"], "left").select(
        *kept,
        F.coalesce("new_status", "status").alias("status"),
        (before | F.col("new_status").isNotNull()).alias("modified"),
    )


def set_all_statuses(rows: DataFrame, status: str, where: Column | None = None) -> DataFrame:
    """Bulk mark, or clear with UNMARKED; ``where`` limits it to some scopes."""
    value = status if status in ROSTER_STATUSES else UNMARKED
    chosen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    before = F.col("modified") if "modified" in rows.columns else F.lit(False)
    return rows.withColumns(
        {"status": F.when(chosen, F.lit(value)).otherwise(F.col("status")), "modified": before | chosen}
    )


def new_session_rows(roster: DataFrame) -> DataFrame:
    """A fresh sheet: one unmarked row per student id, at its first place, with its last data."""
    last = F.max_by(F.struct("roll_number", "name"), F.col("roster_seq"))
    return (
        roster.groupBy("scope_id", "student_id")
        .agg(F.min("roster_seq").alias("roster_seq"), last.alias("s"))
        .select(
            "scope_id",
            "roster_seq",
            "student_id",
            "s.roll_number",
            "s.name",
            F.lit(UNMARKED).alias("status"),
            F.lit("").alias("remarks"),
            F.lit(False).alias("modified"),
        )
    )
