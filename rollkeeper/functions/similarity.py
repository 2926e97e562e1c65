"""Name similarity: the ratio of matching blocks, with bounds that need no Python.

The score itself (Ratcliff-Obershelp) is no built-in, so it runs as an Arrow UDF
over pairs that survive the bounds. ``letters`` turns a word into its characters
numbered per occurrence (``anna`` -> a1 n1 n2 a2); the size of two such sets'
intersection is the multiset overlap, an upper bound on the matched characters.
Letters are worked out once per distinct word; pairs only see numbers.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SLACK = 1e-9
# Any fixed order is exact; rare letters first keep the blocks small.
RARITY = "qxzjwfvcbkpgydmtluoshnriea"


def first_word(name: Column) -> Column:
    return F.regexp_extract(name, "^([^ ]*)", 1)


def last_word(name: Column) -> Column:
    return F.regexp_extract(name, "([^ ]*)$", 1)


def letters(chars: Column) -> Column:
    """Characters numbered per occurrence, from a column holding the split word."""
    return F.transform(
        chars,
        lambda c, i: F.concat(
            c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c)).cast("string")
        ),
    )


def letter_mask(letter_set: Column) -> Column:
    """First and second occurrences of a to z as bits of one number."""

    def bit(c: Column) -> Column:
        place = F.ascii(c) - 97 + 26 * (F.substring(c, 2, 9).try_cast("int") - 1)
        known = c.rlike("^[a-z][12]$")
        return F.when(known, F.pow(F.lit(2.0), place).cast("bigint")).otherwise(0)

    return F.aggregate(letter_set, F.lit(0).cast("bigint"), lambda mask, c: mask.bitwiseOR(bit(c)))


def may_reach(a: Column, b: Column, mask_a: Column, mask_b: Column, bound: Column) -> Column:
    """Whether two words can still reach the ratio ``bound``, in plain arithmetic.

    Shared bits are shared characters; of the characters outside the masks at most
    the smaller number can be shared.
    """
    la, lb = F.length(a), F.length(b)
    rest = F.least(la - F.bit_count(mask_a), lb - F.bit_count(mask_b))
    shared = F.bit_count(mask_a.bitwiseAND(mask_b)) + rest
    return F.lit(2.0) * shared / (la + lb) >= bound - F.lit(SLACK)


def probe_letters(letter_set: Column, bound: Column) -> Column:
    """The letters of which a partner reaching ``bound`` must share at least one.

    With 2*o/(x+y) >= t and o <= y, the overlap o is at least t/(2-t)*x. Two sets
    sharing o elements must meet inside their first x-o+1 elements under one order.
    """
    rank = F.transform(
        letter_set,
        lambda c: F.struct(
            (-F.substring(c, 2, 9).try_cast("int")).alias("repeat"),
            F.instr(F.lit(RARITY), F.substring(c, 1, 1)).alias("rare"),
            c.alias("c"),
        ),
    )
    size = F.size(letter_set)
    need = F.ceil(size * bound / (F.lit(2.0) - bound) - F.lit(SLACK)).cast("int")
    keep = size - F.greatest(need, F.lit(1)) + F.lit(1)
    return F.transform(F.slice(F.array_sort(rank), F.lit(1), keep), lambda s: s["c"])


def name_score(a: str, b: str, first_bound: float = 0.70, last_bound: float = 0.60) -> float:
    """Ratio of two normalised names; 0 when first or last words differ too much."""
    left, right = a.split(), b.split()
    if len(left) >= 2 and len(right) >= 2:
        if _ratio(left[0], right[0]) < first_bound or _ratio(left[-1], right[-1]) < last_bound:
            return 0.0
    return _ratio(a, b)


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of each pair, which is not the same the other way round."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")
