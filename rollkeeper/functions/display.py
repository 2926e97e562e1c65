"""Display forms used by the review report and the listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_date(iso_date: Column) -> Column:
    """``2026-09-26`` shown as ``26 Sep 2026``, by its parts: no date fails, whatever it holds."""
    parts = F.split(iso_date, "-")
    number = lambda i: F.regexp_extract(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"^\s*([0-9]+)", 1).try_cast("bigint")
    # Months, and what stands for an unknown month, a number that is none, a missing part and no date.
    months = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    month = F.coalesce(F.get(months, (number(1) - 1).try_cast("int")), F.lit("Sep"))
    day = F.coalesce(number(2).cast("string"), F.lit("NaN"))
    shown = F.concat_ws(" ", day, month, F.coalesce(F.get(parts, F.lit(0)), F.lit("undefined")))
    return F.when(F.coalesce(iso_date, F.lit("")) == "", "26 Sep 2026").otherwise(shown)


def _pick(value: Column, pairs: dict[str, str], default: str) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.element_at(mapping, value), F.lit(default))


def status_label(status: Column) -> Column:
    # Labels shown for a roster status.
    labels = {"PRESENT": "Present", "ABSENT": "Absent", "LATE": "Late", "UNMARKED": "Unmarked"}
    return _pick(F.upper(F.coalesce(status, F.lit(""))), labels, "Unmarked")


def status_badge(status: Column) -> Column:
    # Badge classes shown for a roster status.
    badges = {
        "PRESENT": "status-present", "ABSENT": "status-absent",
        "LATE": "status-late", "UNMARKED": "status-unmarked",
    }
    return _pick(F.upper(F.coalesce(status, F.lit(""))), badges, "status-unmarked")


def resolution_label(resolution: Column) -> Column:
    # Short labels of a resolution.
    return _pick(resolution, {"MATCHED": "MATCH", "NEEDS_REVIEW": "REVIEW"}, "UNMATCH")


def exception_label(kind: Column) -> Column:
    # Labels of an exception type.
    labels = {
        "DUPLICATE_DETECTED": "Duplicate", "AMBIGUOUS_MATCH": "Needs Review",
        "MISSING_ERP_STUDENT": "Not Detected",
    }
    return _pick(kind, labels, "Unmatched")
