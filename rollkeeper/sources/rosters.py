"""Class rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# snake_case field -> camelCase alias
FIELDS = {
    "student_id": "studentId",
    "roll_number": "rollNumber",
    "name": None,
    "enrollment_number": "enrollmentNumber",
    "email": None,
    "gender": None,
    "status": None,
    "remarks": None,
}
KEYS = ["scope_id", "roster_seq"]
JSON_SCHEMA = ", ".join(
    f"{name} string" for pair in FIELDS.items() for name in pair if name is not None
)


def split_roster(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roster rows with an id and a name, and the quarantined rest.

    Either spelling of a field is read, and columns outside the model are dropped.
    """
    present = set(raw.columns)
    fields = []
    for field, alias in FIELDS.items():
        names = [n for n in (alias, field) if n is not None and n in present]
        value = F.coalesce(*[F.col(n).cast("string") for n in names]) if names else F.lit(None).cast("string")
        fields.append(value.alias(field))
    rows = raw.select(*KEYS, *fields)
    complete = F.col("student_id").isNotNull() & F.col("name").isNotNull()
    return rows.filter(complete), rows.filter(~complete)


def parse_roster_json(lines: DataFrame, column: str = "payload") -> DataFrame:
    """Expand one JSON object per row into the columns ``split_roster`` reads."""
    parsed = F.from_json(F.col(column), JSON_SCHEMA)
    return lines.select(*KEYS, parsed.alias("row")).select(*KEYS, "row.*")
