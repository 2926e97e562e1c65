"""Text cleaning. Word characters are Unicode letters, numbers and underscore."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f"
# The characters of that class, for trimming.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# A word boundary spelled out, since Java's \b also counts combining marks.
WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind."""
    return F.btrim(text, F.lit(BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def strip_to_null(text: Column) -> Column:
    return blank_to_null(strip(text))


def strip_upper(text: Column) -> Column:
    return F.upper(strip(text))


def normalize_name(name: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed; null gives an empty string."""
    spaced = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"(?U)[^{WORD}\s]", " ")
    return strip(F.regexp_replace(spaced, rf"(?U)[{BLANK}]+", " "))


def strip_leading_zeros(text: Column) -> Column:
    """May give an empty string for an all-zero text."""
    return F.regexp_replace(text, "^0+", "")


def roll_digits(text: Column) -> Column:
    """First digit run standing as a whole word, else null."""
    found = F.regexp_extract(text, rf"{WORD_START}(\p{{Nd}}+){WORD_END}", 1)
    return blank_to_null(found)


def roll_number_key(text: Column) -> Column:
    """The digit run as an integer written without leading zeros (no overflow)."""
    return F.regexp_replace(roll_digits(text), r"^0+(?=\p{Nd})", "")


def _folds() -> tuple[str, str]:
    """Letters that are another letter with marks of U+0300 to U+036F, and those letters."""
    accented, plain = [], []
    for code in range(0xC0, 0x110000):
        letter = chr(code)
        whole = unicodedata.normalize("NFD", letter)
        bare = "".join(ch for ch in whole if not "\u0300" <= ch <= "\u036f")
        # Decomposed forms without such marks stay composed, which is the same text.
        if len(bare) == 1 and bare != letter and len(whole) > 1:
            accented.append(letter)
            plain.append(bare)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _folds()


def fold_accents(name: Column) -> Column:
    """Accent-insensitive display key: letters without their marks, in lower case, blanks collapsed."""
    no_marks = F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), _ACCENTED, _PLAIN), r"[\u0300-\u036f]", "")
    return strip(F.regexp_replace(F.lower(no_marks), rf"(?U)[{BLANK}]+", " "))


def same_name_ignoring_accents(left: Column, right: Column) -> Column:
    """Equality under the built-in case- and accent-insensitive collation."""
    return F.collate(left, "UNICODE_CI_AI") == F.collate(right, "UNICODE_CI_AI")
