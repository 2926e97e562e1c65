"""Whole documents of a sheet or scope as JSON, written in pieces.

A document can be as large as its scope, so it is never one value on the way: every row becomes a piece, pieces are
sorted within their scope and joined to blocks of bounded size as they pass. The blocks of a document, in
order, are its text; ``write_documents`` stores them so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.plans.reconcile import Reconciliation

BLOCK_CHARS = 1 << 20


# How a piece goes on: a new element of its list, an element of a list within it, or more of the same text.
ELEMENT, NESTED, MORE = 0, 1, 2
# Rows, up to three ordering columns, how it goes on, and the text.
Source = tuple[DataFrame, list, int, Column]


def _pieces(key: str, parts: list[list[Source]]) -> DataFrame:
    """``key, part, place, how, piece`` of all sources of all parts."""
    rows = None
    for i, sources in enumerate(parts):
        for frame, order, how, value in sources:
            order = [F.col(n) if isinstance(n, str) else F.lit(n) for n in (*order, 0, 0, 0)[:3]]
            place = F.struct(*[F.coalesce(n.cast("bigint"), F.lit(0)).alias(f"p{k}") for k, n in enumerate(order)])
            found = frame.select(key, F.lit(i).alias("part"), place.alias("place"), F.lit(how).alias("how"), value.alias("piece"))
            rows = found if rows is None else rows.unionByName(found)
    return rows


def blocks(pieces: DataFrame, key: str, names: list[str], lists: list[bool], most: int = BLOCK_CHARS) -> DataFrame:
    """``key, block, text``: the documents of sorted pieces, cut into blocks of about ``most`` characters."""
    kind = pieces.schema[key].dataType.simpleString()
    heads = [f'"{n}":' + ("[" if many else "") for n, many in zip(names, lists)]
    ends = ["]" if many else "" for many in lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(key, kinds[0]), ("block", pa.int64()), ("text", pa.string())])
        out, held, size, number, current, part, last = [], [], 0, 0, None, -1, MORE

        def upto(last: int, wanted: int) -> str:
            """What closes part ``last`` and opens all up to ``wanted``; parts between have no rows."""
            text = ends[last] if last >= 0 else '{"success":true'
            for p in range(last + 1, wanted + 1):
                text += "," + heads[p] + (ends[p] if p < wanted else "")
            return text

        def closing() -> str:
            return upto(part, len(names) - 1) + ends[-1] + "}" if part < len(names) - 1 else ends[-1] + "}"

        def give(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for scope, p, how, piece in zip(*(batch.column(n).to_pylist() for n in (key, "part", "how", "piece"))):
                if scope != current or part < 0:
                    if part >= 0:
                        out.append((current, number, "".join([*held, closing()])))
                    held, size, number, current, part = [], 0, 0, scope, -1
                if p > part:
                    text = upto(part, p) + piece
                else:
                    text = "," + piece if how == ELEMENT or how == last == NESTED else piece
                held.append(text)
                size, part, last = size + len(text), p, how
                if size >= most:
                    out.append((current, number, "".join(held)))
                    held, size, number = [], 0, number + 1
                if len(out) >= 1000 or (out and size == 0):
                    yield give(out)
                    out = []
        if part >= 0:
            out.append((current, number, "".join([*held, closing()])))
        if out:
            yield give(out)

    kinds = [pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()]
    dealt = pieces.repartition(key).sortWithinPartitions(key, "part", "place")
    return dealt.select(key, "part", "how", "piece").mapInArrow(run, f"{key} {kind}, block bigint, text string")


def _json(*fields: str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


RECORD = ("raw_name", "raw_identifier", "raw_student_id", "raw_attendance_mark", "status", "confidence")
RESULT = (
    "raw_identifier", "raw_student_id", "raw_name", "raw_attendance_mark", "status", "ai_confidence", "matched_student_id", "matched_roll_number",
    "matched_name", "match_method", "match_confidence", "resolution", "is_duplicate", "review_reason",
)
STUDENT = ("student_id", "roll_number", "name", "enrollment_number", "email", "gender", "status", "remarks")
CANDIDATE = ("student_id", "roll_number", "name", "similarity")


def extraction_documents(records: DataFrame, summary: DataFrame, most: int = BLOCK_CHARS) -> DataFrame:
    """``sheet_id, block, text``: of each sheet its records and their summary."""
    counts = [n for n in summary.columns if n != "sheet_id"]
    pieces = _pieces("sheet_id", [[(records, ["rec_seq"], ELEMENT, _json(*RECORD))], [(summary, [], ELEMENT, _json(*counts))]])
    return blocks(pieces, "sheet_id", ["records", "summary"], [True, False], most)


def match_documents(match: Reconciliation, most: int = BLOCK_CHARS) -> DataFrame:
    """``scope_id, block, text``: of each scope its results with their candidates, its summary, missing students and exceptions."""
    results, counts = match.results, [n for n in match.summary.columns if n != "scope_id"]
    # A result is three pieces or more: its fields, each candidate, and the end.
    opened = F.concat(F.regexp_replace(_json(*RESULT), r"\}$", ""), F.lit(',"candidates":['))
    keyed = results.filter(F.col("candidate_key").isNotNull()).select("scope_id", "rec_seq", "match_step", "candidate_key")
    listed = keyed.join(match.candidates, ["scope_id", "match_step", "candidate_key"])
    parts = [
        [
            (results, ["rec_seq", 0], ELEMENT, opened),
            (listed, ["rec_seq", 1, "position"], NESTED, _json(*CANDIDATE)),
            (results, ["rec_seq", 2], MORE, F.lit("]}")),
        ],
        [(match.summary, [], ELEMENT, _json(*counts))],
        [(match.missing, ["roster_seq"], ELEMENT, _json(*STUDENT))],
        [(match.exceptions, ["phase", "seq", "nth"], ELEMENT, _json("type", "student_id", "name", "message", "details"))],
    ]
    names = ["results", "summary", "erp_students_not_detected", "exceptions"]
    return blocks(_pieces("scope_id", parts), "scope_id", names, [True, False, True, True], most)


def write_documents(documents: DataFrame, folder: str) -> None:
    """Documents as text in blocks, in files that keep the blocks of a document together and in order."""
    documents.write.mode("errorifexists").parquet(folder)
