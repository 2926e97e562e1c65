"""Rosters read out of saved register pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.functions.text import blank_to_null, strip

# A tag's attributes; what stands in quotes is passed over as a whole.
_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
# The ids of the attendance table and its body.
_TABLE = rf"(?is)<(table|tbody)\b{_REST}\sid\s*=\s*[\"']attendance-table(?:-body)?[\"']{_REST}>(.*?)</\1\s*>"
_ROW = rf"(?is)(<tr\b{_REST}\sdata-student-(?:row\s*=\s*[\"']true[\"']|id\s*=){_REST}>.*?</tr>)"


def _attribute(tag: Column, name: str) -> Column:
    """An attribute as it stands in double and in single quotes, null if it is not there; put it in a column, then ``_value``."""
    there = tag.rlike(rf"(?is)^<\w+(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?\s{name}\s*=")
    double = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*\"([^\"]*)\"", 1)
    single = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)
    return F.when(there, F.struct(double.alias("double"), single.alias("single")))


def _value(attribute: str) -> Column:
    """Value of an attribute, empty if it is there without one, null if it is not there."""
    return F.coalesce(blank_to_null(F.col(attribute)["double"]), F.col(attribute)["single"])


def _filled(text: Column) -> Column:
    """``blank_to_null`` of a costly text, worked out once."""
    return F.get(F.filter(F.array(text), lambda t: t != ""), F.lit(0))


def _unescape(text: Column) -> Column:
    """Character references by number, then the named ones that pages are saved with."""

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});", 0)
        hexadecimal = F.lower(F.substring(digits, 1, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.regexp_replace(digits, "[xX;]", ""), 16, 10)).otherwise(F.replace(digits, F.lit(";"), F.lit("")))
        known = (digits != "") & code.cast("bigint").between(1, 0x10FFFF) & ~code.cast("bigint").between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
        return F.when(known, F.concat(char, F.substr(part, F.length(digits) + 1))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    text = F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(one(part))), "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _cell(row: Column, marker: str) -> Column:
    """Visible text of the first element whose opening tag carries ``marker``, with elements of its name nested in it."""
    plain = r"(?:(?!</?\1\b).)*"
    nested = rf"{plain}(?:<\1\b[^>]*>{plain}</\1\s*>{plain})*"
    inner = F.regexp_extract(row, rf"(?is)<(\w+)\b[^>]*{marker}[^>]*>({nested})</\1\s*>", 2)
    return _filled(strip(F.regexp_replace(inner, "<[^>]*>", "")))


def roster_from_pages(pages: DataFrame) -> DataFrame:
    """One row per student row of each page's attendance table: attributes first, cell texts as fallback.

    Tags, controls and attributes are columns of their own, so that each is searched once and not again by every rule.
    """
    # A table holds its body, so the body is looked for only where no table has the id.
    tables = F.regexp_extract_all("html", F.lit(_TABLE), F.lit(2))
    inside = F.array_join(tables, " ")
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(inside, F.lit(_ROW), F.lit(1))).alias("row_seq", "row"))
    row, select, option = F.col("row"), F.col("select"), F.col("option")
    tags = rows.select(
        "page_id",
        "row_seq",
        "row",
        F.regexp_extract(row, rf"(?is)^(<tr\b{_REST}>)", 1).alias("tag"),
        F.regexp_extract(
            row, r"(?is)<select\b[^>]*(?:data-attendance-control\s*=\s*\"true\"|attendance-select)[^>]*>(.*?)</select>", 1
        ).alias("select"),
        F.regexp_extract(row, r"(?is)(<input\b[^>]*(?:remarks-input|data-remarks-control\s*=\s*\"true\")[^>]*>)", 1).alias("input"),
    )
    # The value of a control is that of its selected option or else the first; an option without a value gives its text.
    selected = F.regexp_extract(select, rf"(?is)(<option\b(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)?\sselected(?=[\s=>/]){_REST}>[^<]*)", 1)
    first = F.regexp_extract(select, rf"(?is)(<option\b{_REST}>[^<]*)", 1)
    found = tags.select(
        "page_id",
        "row_seq",
        "row",
        *[_attribute(F.col("tag"), name).alias(name) for name in ("data-student-id", "id", "data-roll-number", "data-student-name", "data-attendance-state")],
        _attribute(F.col("input"), "value").alias("remark"),
        F.coalesce(_filled(selected), first).alias("option"),
    ).withColumn("choice", _attribute(option, "value"))
    text = lambda value: F.coalesce(_unescape(value), F.lit(""))
    worded = strip(F.regexp_replace(option, rf"(?is)^<option\b{_REST}>", ""))
    fields = F.struct(
        "page_id",
        "row_seq",
        text(
            F.coalesce(
                blank_to_null(_value("data-student-id")),
                _cell(row, 'data-field="student-id"'),
                blank_to_null(F.regexp_replace(_value("id"), "^(.*?)row-", "$1")),
            )
        ).alias("student_id"),
        text(F.coalesce(blank_to_null(_value("data-roll-number")), _cell(row, 'data-field="roll-number"'))).alias("roll_number"),
        text(
            F.coalesce(
                blank_to_null(_value("data-student-name")),
                _cell(row, "student-name-text"),
                _cell(row, 'data-field="student-name"'),
            )
        ).alias("name"),
        F.upper(
            F.coalesce(
                _filled(_unescape(F.coalesce(_value("choice"), worded))),
                blank_to_null(_value("data-attendance-state")),
                F.lit("UNMARKED"),
            )
        ).alias("status"),
        strip(text(_value("remark"))).alias("remarks"),
    )
    # Filtered inside the row's list: a filter on the columns would be moved down and work the fields out again.
    return found.select(F.inline(F.filter(F.array(fields), lambda f: (f["student_id"] != "") | (f["roll_number"] != ""))))
