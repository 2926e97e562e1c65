"""Attendance-shaped views over the provided tables.

Each view is one projection (plus key joins) written in SQL both Spark and DuckDB
read, so the check compares the operators, not two derivations of the input.
Ordinals come from the tables' own keys, never from a global row number, and the
number of classes and sheets grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# 60 students per class. Shared, missing, blank and differently padded roll
# numbers, one repeated student id, and shared and near-equal names occur on purpose.
ROSTER = """
SELECT CAST(floor(k / 60) AS BIGINT) AS scope_id,
       k AS roster_seq,
       concat('STU', lpad(CAST(CASE WHEN s = 59 THEN k - 1 ELSE k END AS STRING), 12, '0')) AS student_id,
       CASE WHEN s = 20 THEN NULL WHEN s = 21 THEN '' WHEN s = 11 THEN '010' WHEN s = 12 THEN '12'
            WHEN s = 13 THEN '012' ELSE lpad(CAST(s AS STRING), 3, '0') END AS roll_number,
       CASE WHEN k % 3 = 0 THEN concat(w1, ' ', w2)
            WHEN k % 3 = 1 THEN concat(w1, ' ', w2, lower(substr(seg, 1, 4)))
            ELSE concat(w1, ' ', substr(seg, 1, 1), '. ', w2) END AS name,
       CASE WHEN s = 30 THEN NULL ELSE concat('EN', CAST(k AS STRING)) END AS enrollment_number,
       concat(lower(w1), '.', CAST(k AS STRING), '@school.example') AS email,
       CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
       CASE WHEN k % 17 = 0 THEN 'LATE' WHEN k % 7 = 0 THEN 'PRESENT' WHEN k % 11 = 0 THEN 'ABSENT'
            ELSE 'UNMARKED' END AS status,
       CASE WHEN k % 13 = 0 THEN 'on leave' ELSE '' END AS remarks
FROM (SELECT c_custkey AS k, c_custkey % 60 AS s, c_mktsegment AS seg,
             concat(upper(substr(split_part(full_name, ' ', 1), 1, 1)), substr(split_part(full_name, ' ', 1), 2)) AS w1,
             concat(upper(substr(split_part(full_name, ' ', 2), 1, 1)), substr(split_part(full_name, ' ', 2), 2)) AS w2
      FROM (SELECT c_custkey, c_mktsegment, coalesce(p_name, c_name) AS full_name
            FROM {customer} LEFT JOIN {part} ON p_partkey = c_custkey) AS named) AS parts
"""

# Twelve ways a sheet names a student, by order key. A tenth of the students stay away.
RECORDS = """
SELECT r.scope_id, o.o_orderkey AS rec_seq,
       CASE WHEN m IN (0, 2, 6, 10) THEN r.name
            WHEN m = 1 THEN 'Somebody Else'
            WHEN m = 7 THEN concat('  ', upper(replace(r.name, ' ', '  ')))
            WHEN m = 8 THEN concat(substr(r.name, 1, 2), substr(r.name, 4))
            WHEN m = 9 THEN 'Zyx Unknown'
            WHEN m = 11 THEN concat(split_part(r.name, ' ', 1), ' ', split_part(r.name, ' ', 2), 's.')
            END AS raw_name,
       CASE WHEN m = 2 THEN lower(r.student_id)
            WHEN m = 3 THEN 'Roll ' || r.roll_number
            WHEN m = 4 THEN ' ' || r.roll_number || ' '
            WHEN m = 5 THEN lower(r.enrollment_number)
            WHEN m = 9 THEN concat('ZZ', CAST(o.o_orderkey AS STRING))
            WHEN m = 10 THEN r.student_id
            END AS raw_identifier,
       CASE WHEN m IN (0, 1) THEN concat(' ', lower(r.student_id))
            WHEN m = 10 THEN 'STU999'
            WHEN m = 6 THEN ''
            END AS raw_student_id,
       CASE WHEN o.o_orderstatus = 'F' THEN 'P' WHEN o.o_orderstatus = 'O' THEN 'A'
            ELSE CAST(o.o_orderkey % 40 AS STRING) END AS raw_attendance_mark,
       CASE WHEN o.o_orderstatus = 'O' OR (o.o_orderstatus = 'P' AND o.o_orderkey % 40 = 0)
            THEN 'ABSENT' ELSE 'PRESENT' END AS status,
       0.40e0 + (o.o_orderkey % 60) / 100e0 AS confidence
FROM (SELECT o_orderkey, o_orderstatus, o_orderkey % 12 AS m,
             CASE WHEN o_custkey % 10 = 7 THEN o_custkey - 1 ELSE o_custkey END AS seen FROM {orders}) AS o
JOIN {roster} AS r ON r.roster_seq = o.seen
"""

# Marks as found in an attendance column, and the odd one outside it.
MARKS = """
SELECT event_id,
       CASE event_id % 32 WHEN 0 THEN '1' WHEN 1 THEN '17' WHEN 2 THEN 'A' WHEN 3 THEN ' p ' WHEN 4 THEN '17A'
            WHEN 5 THEN 'P1' WHEN 6 THEN '00' WHEN 7 THEN '#17' WHEN 8 THEN '17.' WHEN 9 THEN '--'
            WHEN 10 THEN 'N/A' WHEN 11 THEN 'I' WHEN 12 THEN 'o' WHEN 13 THEN NULL WHEN 14 THEN '   '
            WHEN 15 THEN 'Present' WHEN 16 THEN '✓' WHEN 17 THEN '✗' WHEN 18 THEN '\\/'
            WHEN 19 THEN 'leave' WHEN 20 THEN 'LATE' WHEN 21 THEN 'x' WHEN 22 THEN '0' WHEN 23 THEN '#0.'
            WHEN 24 THEN 'Status.PRESENT' WHEN 25 THEN 'status.absent' WHEN 26 THEN 'PR' WHEN 27 THEN '|'
            WHEN 28 THEN event_type WHEN 29 THEN concat(CAST(user_id AS STRING), '.')
            WHEN 30 THEN CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) ELSE CAST(user_id AS STRING) END AS mark,
       event_id % 5 <> 4 AS in_column
FROM {events}
"""

# One sheet per order: a row of cells per line, at one of 60 heights of the page.
LINE_BOXES = """
SELECT sheet_id, seq * 8 + 64 + cell AS box_seq,
       CASE WHEN cell = 0 THEN (CASE WHEN v = 3 THEN concat('0u', CAST(slot % 10 AS STRING))
                                     WHEN v = 4 THEN concat(roll, ' STU', roll)
                                     WHEN v = 9 THEN '' ELSE roll END)
            WHEN cell = 1 THEN (CASE WHEN v = 5 THEN concat('STUO', substr(roll, 2))
                                     WHEN v IN (4, 6) OR sheet_id % 10 = 8 THEN '' ELSE concat('STU', roll) END)
            WHEN cell = 2 THEN (CASE WHEN v = 6 THEN concat('STU', roll, ' | ', w1, ' ', w2)
                                     WHEN v = 7 THEN concat(w1, ' $.') WHEN v = 8 THEN '---'
                                     ELSE w1 END)
            WHEN cell = 3 THEN (CASE WHEN v IN (6, 7, 8) THEN ' ' ELSE w2 END)
            ELSE (CASE WHEN q % 10 = 0 THEN 'P' WHEN q % 10 = 1 THEN 'A' WHEN q % 10 = 2 THEN CAST(q AS STRING)
                       WHEN q % 10 = 3 THEN ' Present ' WHEN q % 10 = 4 THEN 'absent' WHEN q % 10 = 5 THEN 'I'
                       WHEN q % 10 = 6 THEN 'O' WHEN q % 10 = 7 THEN '?' WHEN q % 10 = 8 THEN concat(CAST(q AS STRING), '.')
                       ELSE '' END)
            END AS text,
       (10 + (seq + cell * 13) % 90) / 100e0 AS conf,
       CASE cell WHEN 0 THEN 30e0 WHEN 1 THEN 150e0 WHEN 2 THEN 330e0 WHEN 3 THEN 430e0 ELSE 600e0 END AS x0,
       CASE cell WHEN 0 THEN 40e0 WHEN 1 THEN 90e0 WHEN 2 THEN 80e0 WHEN 3 THEN 70e0 ELSE 60e0 END AS wide,
       140e0 + 40 * slot + q % 5 + (cell * 3 + seq) % 4 AS y0,
       CASE WHEN v = 8 AND cell = 2 THEN 3e0 ELSE 18e0 + cell % 3 END AS tall
FROM (SELECT l_orderkey AS sheet_id, (l_partkey * 8 + l_linenumber) * 1000003 + l_suppkey AS seq, (l_partkey * 7 + l_suppkey * 3) % 60 AS slot,
             lpad(CAST((l_partkey * 7 + l_suppkey * 3) % 60 AS STRING), 3, '0') AS roll,
             CAST(l_quantity AS BIGINT) AS q, (l_partkey + l_linenumber) % 12 AS v,
             concat(upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2)) AS w1,
             split_part(p_name, ' ', 2) AS w2, {cells} AS cell
      FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) AS lines
"""

# Title, page data, headers and footers of every sheet.
PAGE_BOXES = """
SELECT sheet_id, box_seq, text, 0.95e0 AS conf, x0, wide, y0, tall
FROM (SELECT o_orderkey AS sheet_id, cell AS box_seq,
             CASE cell WHEN 0 THEN concat('Page No. ', CAST(o_orderkey % 40 AS STRING)) WHEN 1 THEN 'Date: 27-09-2026'
                  WHEN 2 THEN 'Daily Attendance Register'
                  WHEN 3 THEN CASE WHEN o_orderkey % 10 = 7 THEN '' WHEN o_orderkey % 10 = 5 THEN 'S.No' ELSE 'Roll No' END
                  WHEN 4 THEN CASE WHEN o_orderkey % 10 IN (6, 7, 8) THEN '' ELSE 'Student ID' END
                  WHEN 5 THEN CASE WHEN o_orderkey % 10 = 7 THEN '' ELSE 'Student Name' END
                  WHEN 6 THEN CASE WHEN o_orderkey % 10 = 7 THEN '' WHEN o_orderkey % 10 = 4 THEN 'P/A' ELSE 'Attendance' END
                  WHEN 7 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Total Present: 12' WHEN o_orderkey % 3 = 1 THEN 'Teacher Signature' ELSE '' END
                  WHEN 8 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Teacher Signature' WHEN o_orderkey % 3 = 1 THEN 'Total Present: 9' ELSE '' END
                  ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'Mark' ELSE '---' END END AS text,
             CASE cell WHEN 0 THEN 40e0 WHEN 1 THEN 600e0 WHEN 2 THEN 250e0 WHEN 3 THEN 30e0 WHEN 4 THEN 150e0
                  WHEN 5 THEN 330e0 WHEN 6 THEN 590e0 WHEN 7 THEN 40e0 WHEN 8 THEN 500e0 ELSE 560e0 END AS x0,
             CASE cell WHEN 0 THEN 90e0 WHEN 1 THEN 130e0 WHEN 2 THEN 240e0 WHEN 5 THEN 120e0 ELSE 80e0 END AS wide,
             CASE WHEN cell IN (0, 1) THEN 8e0 WHEN cell = 2 THEN 30e0 WHEN cell = 7 THEN 2590e0
                  WHEN cell = 8 THEN 2586e0 + o_orderkey % 8 WHEN cell = 9 THEN 100e0
                  ELSE 70e0 + (o_orderkey + cell * 5) % 7 END AS y0,
             CASE WHEN cell = 9 THEN 12e0 ELSE 20e0 END AS tall
      FROM (SELECT o_orderkey, {page_cells} AS cell FROM {orders}) AS numbered) AS page
"""

OCR_RAW = """
SELECT sheet_id, CAST(box_seq AS BIGINT) AS box_seq, text, conf, x0, x0 + wide AS x1, y0, y0 + tall AS y1,
       800e0 AS img_w, 2700e0 AS img_h
FROM (SELECT * FROM {line_boxes} UNION ALL SELECT * FROM {page_boxes}) AS cells
"""

# Uploads as a manifest with what the file sources report about each file.
UPLOADS = """
SELECT o_orderkey AS sheet_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'scan.JPG' WHEN 1 THEN 'scan.png' WHEN 2 THEN 'scan.webp' WHEN 3 THEN 'notes.txt'
            ELSE 'scan' END AS filename,
       CASE o_orderkey % 7 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN ' IMAGE/PNG ; q=1' WHEN 2 THEN 'application/octet-stream'
            WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'text/plain' ELSE 'image/webp' END AS content_type,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_totalprice * 30 AS BIGINT) END AS length,
       w AS width, h AS height,
       CASE o_orderkey % 10
            WHEN 0 THEN concat('FFD8FFE000104A46494600010100000100010000FFC00011', '08', lpad(hex(h), 4, '0'), lpad(hex(w), 4, '0'), '03012200021101031101', 'FFD9')
            WHEN 1 THEN concat('89504E470D0A1A0A0000000D49484452', lpad(hex(w), 8, '0'), lpad(hex(h), 8, '0'), '0802000000', '00000000', '0000000049454E44AE426082')
            WHEN 2 THEN '524946460A00000057454250'
            WHEN 3 THEN concat('474946383961', substr(lpad(hex(w), 4, '0'), 3, 2), substr(lpad(hex(w), 4, '0'), 1, 2), substr(lpad(hex(h), 4, '0'), 3, 2), substr(lpad(hex(h), 4, '0'), 1, 2), '800000003B')
            WHEN 4 THEN '706C61696E20746578742021'
            WHEN 5 THEN concat('52494646160000005745425056503858', '0A00000000000000', substr(lpad(hex(w - 1), 4, '0'), 3, 2), substr(lpad(hex(w - 1), 4, '0'), 1, 2), '00', substr(lpad(hex(h - 1), 4, '0'), 3, 2), substr(lpad(hex(h - 1), 4, '0'), 1, 2), '00')
            WHEN 6 THEN concat('52494646160000005745425056503820', '0A000000', '000000', '9D012A', substr(lpad(hex(w), 4, '0'), 3, 2), substr(lpad(hex(w), 4, '0'), 1, 2), substr(lpad(hex(h), 4, '0'), 3, 2), substr(lpad(hex(h), 4, '0'), 1, 2))
            WHEN 7 THEN concat('FFD8FFE000104A46494600010100000100010000FFC00011', '08', lpad(hex(h), 4, '0'), lpad(hex(w), 4, '0'), '03012200021101031101')
            WHEN 8 THEN concat('89504E470D0A1A0A0000000D49484452', lpad(hex(w), 8, '0'), lpad(hex(h), 8, '0'), '0802')
            ELSE 'FFD8FFE00010' END AS content_hex
FROM (SELECT *, 20 + o_custkey % 900 AS w, 40 + o_orderkey % 300 AS h FROM {orders}) AS sized
"""

# One taught session per order, some fields left unset.
SESSIONS = """
SELECT o_orderkey AS session_id, CAST(floor(o_custkey / 60) AS BIGINT) AS scope_id,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '  '
            ELSE concat('Class ', CAST(o_custkey % 12 AS STRING)) END AS class_name,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat(' Subject ', o_orderstatus) END AS subject_name,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Section B' END AS section,
       concat('C', CAST(o_custkey % 28 AS STRING)) AS class_id, concat('S-', CAST(o_orderkey % 6 AS STRING)) AS subject_code,
       concat('Teacher ', CAST(o_custkey % 40 AS STRING)) AS submitted_by,
       concat(substr(CAST(o_orderdate AS STRING), 1, 10), ' 11:05 AM') AS submitted_at,
       substr(CAST(o_orderdate AS STRING), 1, 10) AS session_date
FROM {orders}
"""

# The dimension tables of sessions; some sessions name a class or subject that is in neither.
CLASSES = """
SELECT concat('C', CAST(n_nationkey AS STRING)) AS id, n_name AS name, concat('Section ', CAST(n_regionkey AS STRING)) AS section FROM {nation}
"""
SUBJECTS = """
SELECT concat('S-', CAST(r_regionkey AS STRING)) AS code, r_name AS name, 2 + r_regionkey % 3 AS credits,
       CASE WHEN r_regionkey % 2 = 0 THEN 'Theory' ELSE 'Practical' END AS type FROM {region}
"""

# Odd dates and statuses, made of the columns of the views.
ODD_DATE = (
    "CASE session_id % 8 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '2026-9-6' WHEN 3 THEN '2026-13-01' WHEN 4 THEN 'bad' "
    "WHEN 5 THEN '2026-00-7' WHEN 6 THEN '2026-07' ELSE '2026-2-' END"
)
ANY_STATUS = "CASE roster_seq % 5 WHEN 0 THEN NULL WHEN 1 THEN lower(status) WHEN 2 THEN 'unknown' ELSE status END"

SPARK_DIALECT = {
    "cells": "explode(array(0, 1, 2, 3, 4))",
    "page_cells": "explode(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9))",
}
DUCKDB_DIALECT = {
    "cells": "unnest([0, 1, 2, 3, 4])",
    "page_cells": "unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9])",
}


class Views:
    """The views as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        for key, value in SPARK_DIALECT.items():
            text = text.replace("{" + key + "}", value)
        # A backslash starts an escape in a Spark literal, but not in DuckDB.
        return self.spark.sql(text.replace("\\", "\\\\"), **frames)

    def roster(self) -> DataFrame:
        return self._sql(ROSTER, customer=self.table("customer"), part=self.table("part"))

    def records(self) -> DataFrame:
        return self._sql(RECORDS, orders=self.table("orders"), roster=self.roster())

    def marks(self) -> DataFrame:
        return self._sql(MARKS, events=self.table("events"))

    def ocr_flat(self) -> DataFrame:
        lines = self._sql(LINE_BOXES, lineitem=self.table("lineitem"), part=self.table("part"))
        pages = self._sql(PAGE_BOXES, orders=self.table("orders"))
        return self._sql(OCR_RAW, line_boxes=lines, page_boxes=pages)

    def uploads(self) -> DataFrame:
        return self._sql(UPLOADS, orders=self.table("orders"))

    def sessions(self) -> DataFrame:
        return self._sql(SESSIONS, orders=self.table("orders"))

    def classes(self) -> DataFrame:
        return self._sql(CLASSES, nation=self.table("nation"))

    def subjects(self) -> DataFrame:
        return self._sql(SUBJECTS, region=self.table("region"))
