"""Repairs of typical reading errors in identifiers and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.functions.text import WORD, WORD_END, WORD_START, blank_to_null

# Shapes of a student id.
ID_SHAPE = r"STU\p{Nd}+|[A-Z]{2,4}\p{Nd}{2,5}"


def repair_roll(roll: Column) -> Column:
    """A letter O or U read in the second place of a padded roll number is a zero."""
    two = F.regexp_replace(roll, r"^0[oOuU](\p{Nd})$", "00$1")
    return F.regexp_replace(two, r"^0[oOuU](\p{Nd}{2})$", "0$1")


def with_split_identity(df: DataFrame, roll: str, student_id: str, name: str) -> DataFrame:
    """Move an id out of the name or roll column, in this order.

    An id inside the name moves when none was read; a roll that looks like an id is
    taken for one; a roll followed by an id is split and overrides the id.
    """
    in_name = rf"(?i){WORD_START}({ID_SHAPE}){WORD_END}"
    # Only the first hit leaves the name, so its place is kept by the two groups around it.
    around = rf"(?is)^(.*?){WORD_START}(?:{ID_SHAPE}){WORD_END}(.*)$"
    both = rf"(?iU)^(\p{{Nd}}{{1,4}})\s+({ID_SHAPE})$"
    no_id = blank_to_null(F.col(student_id)).isNull()
    df = df.withColumn("_named", F.when(no_id, blank_to_null(F.regexp_extract(F.col(name), in_name, 1))))
    rest = F.regexp_replace(F.regexp_replace(F.col(name), around, "$1$2"), r"^[ |,\-]+|[ |,\-]+$", "")
    df = df.withColumn(name, F.when(F.col("_named").isNotNull(), rest).otherwise(F.col(name)))
    df = df.withColumn(student_id, F.coalesce(F.upper("_named"), F.col(student_id)))
    rolled = F.when(no_id, blank_to_null(F.regexp_extract(F.col(roll), rf"(?i)^({ID_SHAPE})$", 1)))
    df = df.withColumn("_rolled", rolled)
    df = df.withColumn("_both", blank_to_null(F.regexp_extract(F.col(roll), both, 2)))
    split_roll = F.regexp_extract(F.col(roll), both, 1)
    df = df.withColumn(roll, F.when(F.col("_both").isNotNull(), split_roll).otherwise(F.col(roll)))
    df = df.withColumn(student_id, F.coalesce(F.upper("_both"), F.upper("_rolled"), F.col(student_id)))
    return df.drop("_named", "_rolled", "_both")


def repair_student_id(student_id: Column) -> Column:
    """Upper-case prefix; trailing Os beyond three letters and Os in the rest are zeros."""
    prefix = F.upper(F.regexp_extract(student_id, "^([A-Za-z]+)", 1))
    rest = F.regexp_extract(student_id, "(?s)^[A-Za-z]+(.*)$", 1)
    tail = F.length(F.regexp_extract(prefix, "(O*)$", 1))
    moved = F.least(tail, F.greatest(F.length(prefix) - 3, F.lit(0)))
    fixed = F.concat(
        F.substring(prefix, F.lit(1), F.length(prefix) - moved),
        F.repeat(F.lit("0"), moved),
        F.translate(rest, "oO", "00"),
    )
    return F.when(prefix != "", fixed).otherwise(student_id)


def repair_name(name: Column) -> Column:
    """A dollar sign before a dot or a word is a misread capital S."""
    # "$" is no word character, so a boundary behind it means a word character follows.
    return F.regexp_replace(name, rf"\$(\.|(?=[{WORD}]))", "S$1")
