"""Attendance records read from sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.functions.marks import strict_status
from rollkeeper.functions.numeric import round2

DEFAULT_CONFIDENCE = 0.9


def split_records(raw: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records meeting the contract, and the quarantined rest with a reason.

    Contract: a strict status and a confidence inside [0, 1], 0.9 when absent.
    """
    conf = F.coalesce(F.col("confidence").cast("double"), F.lit(DEFAULT_CONFIDENCE))
    checked = raw.withColumn("checked_status", strict_status(F.col("status"))).withColumn("checked_conf", conf)
    reason = F.when(F.col("checked_status").isNull(), "status").when(
        ~F.col("checked_conf").between(0.0, 1.0) | F.isnan("checked_conf"), "confidence"
    )
    checked = checked.withColumn("quarantine_reason", reason)
    texts = ["raw_name", "raw_identifier", "raw_student_id", "raw_attendance_mark"]
    good = checked.filter(F.col("quarantine_reason").isNull()).select(
        *keys,
        *texts,
        F.col("checked_status").alias("status"),
        round2(F.col("checked_conf")).alias("confidence"),
    )
    bad = checked.filter(F.col("quarantine_reason").isNotNull()).select(
        *keys, *texts, "status", "confidence", "quarantine_reason"
    )
    return good, bad
