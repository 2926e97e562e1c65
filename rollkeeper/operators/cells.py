"""Rows of boxes to one record per student."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.config import ABSENT, ATTENDANCE, COLUMN_TYPES, NAME, ROLL_NO, STUDENT_ID
from rollkeeper.functions.headers import (
    FRAGMENTS,
    HEADER_IDENTIFIERS,
    is_header_word,
    is_page_metadata,
)
from rollkeeper.functions.marks import with_mark_outcome
from rollkeeper.functions.numeric import blended_confidence, clamp01, round2
from rollkeeper.functions.repair import repair_name, repair_roll, repair_student_id, with_split_identity
from rollkeeper.functions.text import blank_to_null, strip

ROW = ["sheet_id", "row_index"]
UNREAD_CONFIDENCE = 0.85
NO_MARK_CONFIDENCE = 0.45


def cell_of_box(columns: Column, cx: Column) -> Column:
    """Column type of a box: the column around its centre, else the nearest one."""
    inside, away = None, []
    for kind in (ATTENDANCE, ROLL_NO, STUDENT_ID, NAME):
        column = columns[kind]
        hit = cx.between(column["low"], column["high"])
        inside = F.when(hit, kind) if inside is None else inside.when(hit, kind)
        away.append(
            F.when(
                column.isNotNull(),
                F.struct(F.abs(cx - column["cx"]).alias("away"), column["place"].alias("place"), F.lit(kind).alias("kind")),
            )
        )
    return inside.otherwise(F.least(*away)["kind"])


def cell_texts(celled: DataFrame) -> DataFrame:
    """One row per register line: the text of each cell and the mean confidence.

    A cell's boxes are gathered since the cell's text is all of them, left to right.
    The confidence is summed as a decimal, so it does not depend on their order.
    """
    box = F.struct("min_x", "cy", "box_seq", "text", "cell")

    def text_of(kind: str) -> Column:
        texts = F.transform(F.filter("boxes", lambda b: b["cell"] == kind), lambda b: strip(b["text"]))
        return blank_to_null(strip(F.array_join(texts, " "))).alias(kind)

    mean = F.sum(F.col("conf").cast("decimal(20,17)")).cast("double") / F.count("*")
    # One list for all cells of a row, sorted once, by the structs' own order: ``array_sort`` calls a lambda for each pair.
    lines = celled.groupBy(*ROW).agg(F.sort_array(F.collect_list(box)).alias("boxes"), mean.alias("mean"))
    row_confidence = F.coalesce("mean", F.lit(UNREAD_CONFIDENCE)).alias("row_confidence")
    return lines.select(*ROW, *[text_of(kind) for kind in COLUMN_TYPES], row_confidence)


def repaired_rows(texts: DataFrame) -> DataFrame:
    """Raw fields after repairing misread and misplaced identifiers."""
    rows = texts.select(
        *ROW,
        repair_roll(F.col(ROLL_NO)).alias("raw_identifier"),
        F.col(STUDENT_ID).alias("raw_student_id"),
        F.col(NAME).alias("raw_name"),
        F.col(ATTENDANCE).alias("raw_attendance_mark"),
        "row_confidence",
    )
    rows = with_split_identity(rows, "raw_identifier", "raw_student_id", "raw_name")
    return rows.withColumn("raw_student_id", repair_student_id(F.col("raw_student_id"))).withColumn(
        "raw_name", repair_name(F.col("raw_name"))
    )


def records_from_rows(rows: DataFrame) -> DataFrame:
    """Status and confidence of each row; rows with neither identity nor mark go."""
    mark = F.col("raw_attendance_mark")
    named = (
        blank_to_null(F.col("raw_identifier")).isNotNull()
        | blank_to_null(F.col("raw_student_id")).isNotNull()
        | F.coalesce(F.length("raw_name") >= 2, F.lit(False))
    )
    marked = with_mark_outcome(rows.filter(mark.isNotNull() | named), "raw_attendance_mark")
    mixed = marked.withColumn("mixed", blended_confidence(F.col("norm.conf"), F.col("row_confidence")))
    return mixed.select(
        *ROW,
        "raw_name",
        F.coalesce(blank_to_null(F.col("raw_identifier")), F.col("raw_student_id")).alias("raw_identifier"),
        "raw_student_id",
        F.when(mark.isNotNull(), F.col("norm.mark")).alias("raw_attendance_mark"),
        F.when(mark.isNotNull(), F.col("norm.status")).otherwise(ABSENT).alias("status"),
        F.when(mark.isNotNull(), round2(F.col("mixed"))).otherwise(NO_MARK_CONFIDENCE).alias("confidence"),
    )


def reject_reason() -> Column:
    """Why a record is no student row; null for a good record."""
    name = strip(F.coalesce(F.col("raw_name"), F.lit("")))
    ident = strip(F.coalesce(blank_to_null(F.col("raw_identifier")), F.col("raw_student_id"), F.lit("")))
    student_id = strip(F.coalesce(F.col("raw_student_id"), F.lit("")))
    unnamed = (ident == "") & (student_id == "")
    return (
        F.when(unnamed & (name == ""), "no identity")
        .when((name != "") & is_page_metadata(name), "page metadata")
        .when(is_header_word(name), "header name")
        .when(F.lower(ident).isin(HEADER_IDENTIFIERS), "header identifier")
        .when(unnamed & ((F.length(name) <= 1) | name.isin(FRAGMENTS)), "fragment")
    )


def validated(rows: DataFrame) -> DataFrame:
    """Rows with ``reject_reason``; keep those where it is null.

    The identifier a row is judged by is its roll number, else its student id.
    """
    return rows.withColumn("reject_reason", reject_reason())


def contracted(records: DataFrame) -> DataFrame:
    """Records as handed to matching: texts stripped, confidence inside [0, 1].

    The mark rules only yield statuses of the contract, so nothing is quarantined.
    """
    texts = ("raw_name", "raw_identifier", "raw_student_id", "raw_attendance_mark")
    return records.select(
        "sheet_id",
        F.col("row_index").alias("rec_seq"),
        *[strip(F.col(t)).alias(t) for t in texts],
        "status",
        clamp01(F.col("confidence")).alias("confidence"),
    )
