"""Attendance marks to PRESENT / ABSENT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.config import ABSENT, PRESENT
from rollkeeper.functions.text import strip

# Mark vocabularies of the tolerant rule.
PRESENT_TOKENS = ["P", "PRESENT", "PRES", "PR", "ATTENDED", "YES", "Y", "TRUE", "V", "✓", "✔", "\\/"]
ABSENT_TOKENS = ["A", "ABSENT", "ABS", "AB", "LEAVE", "NO", "N", "FALSE", "X", "✗", "✘", "-"]
# Mark vocabularies of the strict rule.
STRICT_PRESENT = ["P", "PRESENT", "PRES", "ATTENDED", "Y", "YES", "1", "TRUE", "V", "✓"]
STRICT_ABSENT = ["A", "ABSENT", "ABS", "LEAVE", "N", "NO", "0", "FALSE", "X", "✗", "-"]

POSITIVE_NUMBER = r"^[0-9]*[1-9][0-9]*$"


def is_positive_number(text: Column) -> Column:
    """All digits and above zero, tested on the text so that no length overflows."""
    return strip(text).rlike(POSITIVE_NUMBER)


def _outcome(status: str, confidence: float, mark: Column) -> Column:
    return F.struct(
        F.lit(status).alias("status"),
        F.lit(confidence).alias("conf"),
        mark.alias("mark"),
    )


def with_mark_outcome(df: DataFrame, mark: str, in_column: Column | bool = True, out: str = "norm") -> DataFrame:
    """Add struct ``status, conf, mark``; the first rule that applies decides.

    The cleaned forms of the mark are columns of their own, so that each is
    computed once and not again in every branch.
    """
    # The confidence of each rule.
    in_col = in_column if isinstance(in_column, Column) else F.lit(in_column)
    raw, upper, letters, counted = (F.col(c) for c in ("_raw", "_upper", "_letters", "_counted"))
    outcome = (
        F.when(raw.isNull() | (raw == ""), _outcome(ABSENT, 0.40, F.lit("")))
        .when(upper.isin(ABSENT_TOKENS + ["0"]), _outcome(ABSENT, 0.98, raw))
        .when(letters.isin(ABSENT_TOKENS), _outcome(ABSENT, 0.96, raw))
        .when(upper.isin(PRESENT_TOKENS), _outcome(PRESENT, 0.98, raw))
        .when(letters.isin(PRESENT_TOKENS), _outcome(PRESENT, 0.96, raw))
        .when(in_col & raw.rlike(POSITIVE_NUMBER), _outcome(PRESENT, 0.97, raw))
        .when(in_col & counted.rlike(POSITIVE_NUMBER), _outcome(PRESENT, 0.95, counted))
        .when(in_col & (counted != ""), _outcome(ABSENT, 0.95, F.lit("0")))
        .when(in_col & upper.isin("I", "L", "|", "/"), _outcome(PRESENT, 0.60, raw))
        .when(in_col & upper.isin("O", "D"), _outcome(ABSENT, 0.55, raw))
        .otherwise(_outcome(ABSENT, 0.45, raw))
    )
    return (
        df.withColumn("_raw", strip(F.col(mark)))
        .withColumn("_upper", F.upper("_raw"))
        .withColumn("_letters", F.regexp_replace("_upper", "[^A-Za-z✓✔✗✘]", ""))
        .withColumn("_counted", F.regexp_extract("_raw", r"^#?([0-9]+)\.?$", 1))
        .withColumn(out, outcome)
        .drop("_raw", "_upper", "_letters", "_counted")
    )


def strict_status(value: Column) -> Column:
    """PRESENT, ABSENT, or null for a value outside the contract."""
    clean = F.upper(strip(value))
    return (
        F.when(clean.isin(STRICT_PRESENT) | clean.endswith(".PRESENT"), PRESENT)
        .when(clean.isin(STRICT_ABSENT) | clean.endswith(".ABSENT"), ABSENT)
        .when(clean.rlike(POSITIVE_NUMBER), PRESENT)
    )
