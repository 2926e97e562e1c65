"""Exact lookups: six keys per student, one join for all of them.

A record can be found under six keys. Six left joins would shuffle the wide
records six times, so both sides are put into long form instead, ``(scope_id,
step, match_key)``, and joined once; the smallest step that hits wins. Roster
keys are aggregated to one row per key first, so the join never fans out, and a
key that many records share only grows the probe side, which AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.functions.text import (
    blank_to_null,
    normalize_name,
    roll_number_key,
    strip,
    strip_upper,
)

RECORD = ["scope_id", "rec_seq"]
LOOKUP = ["scope_id", "step", "match_key"]

BY_STUDENT_ID, BY_ROLL, BY_ROLL_NUMBER, BY_ENROLLMENT, BY_NAME, BY_NORMAL_NAME, BY_FUZZY = range(1, 8)
EXACT_STEPS = (BY_STUDENT_ID, BY_ROLL, BY_ROLL_NUMBER, BY_ENROLLMENT, BY_NAME, BY_NORMAL_NAME)
# Steps whose key belongs to one student by definition: the last roster row wins.
LAST_WINS = (BY_STUDENT_ID, BY_ENROLLMENT)


def _long(df: DataFrame, payload: list[str], keys: dict[int, Column], steps) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(step).alias("step"), blank_to_null(key).alias("match_key"))
            for step, key in keys.items()
            if step in steps
        ]
    )
    return (
        df.select(*payload, F.explode(entries).alias("entry"))
        .select(*payload, "entry.step", "entry.match_key")
        .filter(F.col("match_key").isNotNull())
    )


def roster_keys(roster: DataFrame, steps=EXACT_STEPS) -> DataFrame:
    """One row per student and key."""
    keys = {
        BY_STUDENT_ID: strip_upper(F.col("student_id")),
        BY_ROLL: strip_upper(F.col("roll_number")),
        BY_ROLL_NUMBER: roll_number_key(strip(F.col("roll_number"))),
        BY_ENROLLMENT: strip_upper(F.col("enrollment_number")),
        BY_NAME: strip(F.col("name")),
        BY_NORMAL_NAME: normalize_name(F.col("name")),
    }
    return _long(roster, ["scope_id", "roster_seq", "student_id", "roll_number", "name"], keys, steps)


def roster_index(roster: DataFrame, steps=EXACT_STEPS) -> DataFrame:
    """One row per key: how many students hold it, and the last of them."""
    student = F.struct("student_id", "roll_number", "name")
    return (
        roster_keys(roster, steps)
        .groupBy(*LOOKUP)
        .agg(F.count("*").alias("holders"), F.max_by(student, F.col("roster_seq")).alias("student"))
    )


def record_keys(records: DataFrame, steps=EXACT_STEPS) -> DataFrame:
    """One row per record and key it can be looked up by."""
    ident = blank_to_null(strip(F.col("raw_identifier")))
    name = strip(F.col("raw_name"))
    keys = {
        BY_STUDENT_ID: F.upper(F.coalesce(blank_to_null(strip(F.col("raw_student_id"))), ident)),
        BY_ROLL: F.upper(ident),
        BY_ROLL_NUMBER: roll_number_key(ident),
        BY_ENROLLMENT: F.upper(ident),
        BY_NAME: name,
        BY_NORMAL_NAME: normalize_name(name),
    }
    return _long(records, RECORD, keys, steps)


def lookup_hits(records: DataFrame, roster: DataFrame, steps=EXACT_STEPS) -> DataFrame:
    """Every key of a record that the roster knows."""
    return record_keys(records, steps).join(roster_index(roster, steps), LOOKUP)


def best_hits(records: DataFrame, roster: DataFrame, steps=EXACT_STEPS) -> DataFrame:
    """The hit of the first step per record."""
    hit = F.struct("step", "match_key", "holders", "student")
    return lookup_hits(records, roster, steps).groupBy(*RECORD).agg(F.min_by(hit, F.col("step")).alias("hit"))
