"""Every operator as a query over the provided tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeeper.config import COLUMN_TYPES, PRESENT, MatchConfig
from rollkeeper.functions import display, headers, marks, numeric, repair, text
from rollkeeper.operators import apply, cells, exceptions, fuzzy, lookups, matching, regions, report, rows, tallies
from rollkeeper.plans import documents, extract, history, reconcile, sinks
from rollkeeper.plans.versions import RosterVersions
from rollkeeper.session import configure, shared_folder, stage
from rollkeeper.sources import ocr, pages, records, rosters, sessions, uploads
from rollkeeper.testdata import ANY_STATUS, ODD_DATE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_STORED: dict[tuple[str, str, str], DataFrame] = {}
KEYS = ["scope_id", "rec_seq"]
STATUSES = ("UNMARKED", "PRESENT", "ABSENT", "LATE")
c = F.col


def forget_stored() -> None:
    """Drop the memory of stored intermediate tables, so a query builds its own."""
    _STORED.clear()


class Inputs(Views):
    """The views, with the tables several operators start from stored once per session and state of the folder."""

    def _key(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, f"{self.folder}#{self._state()}", name

    @lru_cache(maxsize=1)  # noqa: B019
    def _state(self) -> int:
        """A digest of the files behind the views, so that a changed table is read anew."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        found, listed = [], root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(root, True)
        while listed.hasNext():
            file = listed.next()
            found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
        return hash(tuple(sorted(found)))

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = self._key(name)
        if key not in _STORED:
            _STORED[key] = stage(build())
        return _STORED[key]

    def roster(self) -> DataFrame:
        """The roster spread over tasks: its table is small, often one split, and what queries do with a row is not."""
        return super().roster().repartition("roster_seq")

    def good_records(self) -> DataFrame:
        return records.split_records(self.records(), KEYS)[0]

    def polygons(self) -> DataFrame:
        corner = lambda x, y: F.array(c(x), c(y))
        box = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
        return self.ocr_flat().select(
            "sheet_id", "box_seq", box.alias("bbox"), "text", "conf", "img_w", "img_h"
        )

    def boxes_once(self) -> DataFrame:
        """The boxes for a query that reads them once: nothing is written, and columns it has no use for are not made."""
        return ocr.boxes_from_polygons(self.polygons())

    def boxes(self) -> DataFrame:
        """Stored by their edges; centres and sizes are worked out as they are read."""
        return ocr.with_centres(self._stored("boxes", lambda: ocr.edges_from_polygons(self.polygons())))

    def telling(self) -> DataFrame:
        return self._stored("telling", lambda: regions.telling_boxes(self.boxes(), rows.ROLL_ANCHOR, rows.ID_ANCHOR))

    def tops(self) -> DataFrame:
        return self._stored("tops", lambda: regions.sheet_tops(self.boxes(), telling=self.telling()))

    def ends(self) -> DataFrame:
        return self._stored("ends", lambda: regions.with_body_bottom(self.tops(), self.telling()))

    def layouts(self) -> DataFrame:
        return self._stored("layouts", lambda: regions.page_layouts(self.ends(), self.boxes(), telling=self.telling()))

    def anchors(self) -> DataFrame:
        return self._stored("anchors", lambda: rows.row_anchors(self.telling(), self.layouts()))

    def bands(self) -> DataFrame:
        return self._stored("bands", lambda: rows.row_bands(rows.distinct_anchors(self.anchors())))

    def placed(self) -> DataFrame:
        """Read once by each query, so not stored; the stages it is made of are."""
        return extract.placed_boxes(self.boxes())

    def line_texts(self) -> DataFrame:
        return cells.cell_texts(self.placed())

    def raw_rows(self) -> DataFrame:
        return self._stored("raw_rows", lambda: cells.repaired_rows(self.line_texts()))

    def extracted(self) -> DataFrame:
        """Validated records of the sheets."""
        checked = cells.validated(self.raw_rows())
        return cells.records_from_rows(checked.filter(c("reject_reason").isNull()).drop("reject_reason"))

    def match(self) -> reconcile.Reconciliation:
        """The full match, fuzzy step included, over stored results."""
        key = self._key("match")
        if key not in _STORED:
            # Both are views over joins that the match reads many times.
            records, roster = self._stored("records", self.good_records), self._stored("roster", self.roster)
            _STORED[key] = reconcile.reconcile(records, roster)
        return _STORED[key]

    def open_names(self) -> DataFrame:
        found = matching.find_exact(self.good_records(), self.roster())
        return found.filter(c("hit").isNull() & (c("norm_name") != "")).select(*fuzzy.NAME_KEY).distinct()

    def approved(self) -> DataFrame:
        """Records ready to apply, a different subset of fields left empty in each."""
        n = c("rec_seq") % 6
        return self.match().results.select(
            *KEYS,
            F.when(n < 3, c("matched_student_id")).when(n == 3, F.lit("nobody")).alias("student_id"),
            F.when((n == 3) | (n == 4), F.coalesce("matched_roll_number", "raw_identifier")).alias("roll_number"),
            F.coalesce("matched_name", "raw_name").alias("name"),
            F.when(n == 0, F.lower("status")).when(c("rec_seq") % 13 == 0, "LATE").otherwise(c("status")).alias("status"),
            F.when(c("rec_seq") % 4 == 0, F.concat(F.lit("note "), c("rec_seq").cast("string"))).otherwise("").alias("remarks"),
        )

    def roster_rows(self) -> DataFrame:
        return self.roster().withColumn("locked", c("roster_seq") % 31 == 7)

    def identities(self) -> DataFrame:
        """Identity fields as misread on sheets."""
        return self._sql(IDENTITIES, lineitem=self.table("lineitem"))


# Identity fields as misread on sheets, one row per line item.
IDENTITIES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity,
       CASE v WHEN 0 THEN concat('0u', CAST(l_partkey % 10 AS STRING)) WHEN 1 THEN concat('0O', CAST(l_partkey % 90 + 10 AS STRING))
              WHEN 2 THEN concat(CAST(l_partkey % 99 AS STRING), '  stu', CAST(l_suppkey AS STRING)) WHEN 3 THEN concat('BCA', CAST(l_partkey % 900 + 100 AS STRING))
              WHEN 4 THEN NULL ELSE lpad(CAST(l_partkey % 99 AS STRING), 3, '0') END AS roll,
       CASE v WHEN 5 THEN concat('STUOO', CAST(l_partkey % 9 AS STRING)) WHEN 6 THEN concat('stuo', CAST(l_partkey % 9 AS STRING), 'o')
              WHEN 7 THEN CAST(l_partkey AS STRING) WHEN 8 THEN 'OOOOO1' END AS student_id,
       CASE v WHEN 4 THEN concat('STU', CAST(l_suppkey AS STRING), ' | Rahul Kumar') WHEN 9 THEN concat('Priya - ab', CAST(l_partkey % 900 + 100 AS STRING), ' ,')
              WHEN 10 THEN 'Rahul $.' WHEN 11 THEN '$ingh $ Cost$' WHEN 12 THEN NULL ELSE 'Aarav Sharma' END AS name
FROM (SELECT *, (l_partkey + l_linenumber) % 13 AS v FROM {lineitem}) AS numbered
"""


def query(name: str):
    """Register a builder of ``Inputs`` under the name."""

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Inputs(configure(spark), folder))

        QUERIES[name] = run
        return build

    return register


def _flat(results: DataFrame) -> DataFrame:
    names = [
        *KEYS, "raw_student_id", "status", "ai_confidence", "match_confidence", "matched_student_id",
        "matched_roll_number", "matched_name", "match_method", "resolution", "review_reason", "candidates_count",
    ]
    return results.select(*names)


# --- scalar rules -----------------------------------------------------------------


@query("f1_normalize_attendance")
def _(v: Inputs):
    out = marks.with_mark_outcome(v.marks(), "mark", c("in_column"))
    return out.select("event_id", c("norm.status").alias("status"), c("norm.conf").alias("conf"), c("norm.mark").alias("mark"))


@query("f2_positive_number")
def _(v):
    return v.marks().select("event_id", marks.is_positive_number(c("mark")).alias("is_number"))


@query("f3_strict_status")
def _(v):
    return v.marks().select("event_id", marks.strict_status(c("mark")).alias("status"))


def _prices(v: Inputs) -> DataFrame:
    return v.table("orders").select(
        "o_orderkey",
        (c("o_totalprice") / 600000.0).alias("x"),
        ((c("o_orderkey") % 2000) / 2000.0).alias("y"),
    )


@query("f4_clamp_confidence")
def _(v):
    return _prices(v).select("o_orderkey", numeric.clamp01(c("x") * 3.0 - 1.0).alias("clamped"))


@query("f5_round2")
def _(v):
    return _prices(v).select("o_orderkey", numeric.round2(c("x")).alias("x2"), numeric.round2(c("y")).alias("y2"))


@query("f6_blended_confidence")
def _(v):
    return (
        _prices(v)
        .withColumn("mixed", numeric.blended_confidence(c("y"), c("x")))
        .select("o_orderkey", numeric.round2(c("mixed")).alias("confidence"))
    )


@query("f7_normalize_name")
def _(v):
    return v.records().select(*KEYS, text.normalize_name(c("raw_name")).alias("norm_name"))


@query("f8_roll_digits")
def _(v):
    ident = c("raw_identifier")
    return v.records().select(
        *KEYS, text.roll_digits(ident).alias("digits"), text.roll_number_key(ident).alias("number_key")
    )


@query("f9_accent_key")
def _(v):
    talks = v.table("conversations").select("conv_id", "turn", "text")
    docs = v.table("documents").select((-1 - c("doc_id")).alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), "text")
    return talks.unionByName(docs).select("conv_id", "turn", text.fold_accents(c("text")).alias("key"))


@query("f10_strip_leading_zeros")
def _(v):
    return v.roster().select("roster_seq", text.strip_leading_zeros(c("roll_number")).alias("roll"))


@query("f11_confidence_band")
def _(v):
    return _prices(v).select("o_orderkey", numeric.confidence_band(numeric.round2(c("y"))).alias("band"))


@query("f12_repair_roll")
def _(v):
    return v.identities().select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", repair.repair_roll(c("roll")).alias("roll"))


@query("f13_split_identity")
def _(v):
    return repair.with_split_identity(v.identities(), "roll", "student_id", "name")


@query("f14_repair_student_id")
def _(v):
    return v.identities().select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", repair.repair_student_id(c("student_id")).alias("student_id")
    )


@query("f15_repair_name")
def _(v):
    return v.identities().select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", repair.repair_name(c("name")).alias("name"))


@query("f16_page_metadata")
def _(v):
    return v.boxes_once().select("sheet_id", "box_seq", headers.is_page_metadata(c("text")).alias("is_metadata"))


@query("f17_banner")
def _(v):
    return v.boxes_once().select("sheet_id", "box_seq", headers.is_banner(c("text")).alias("is_banner"))


@query("f18_header_type")
def _(v):
    return v.boxes_once().select("sheet_id", "box_seq", headers.header_type(c("text")).alias("col_type"))


@query("f19_display_date")
def _(v):
    taught = v.sessions()
    odd = taught.select((-c("session_id")).alias("session_id"), F.expr(ODD_DATE).alias("session_date"))
    both = taught.select("session_id", "session_date").unionByName(odd)
    return both.select("session_id", display.display_date(c("session_date")).alias("shown"))


@query("f20_name_scores")
def _(v):
    return fuzzy.scored_pairs(v.open_names(), v.roster()).select("scope_id", "norm_name", "erp_name", "score")


@query("f21_status_labels")
def _(v):
    status = F.expr(ANY_STATUS)
    return v.roster().select("roster_seq", display.status_label(status).alias("label"), display.status_badge(status).alias("badge"))


@query("f22_percent")
def _(v):
    return _prices(v).select("o_orderkey", numeric.percent(c("y")).alias("shown"))


# --- intake -------------------------------------------------------------------------


def _checked_uploads(v: Inputs) -> DataFrame:
    return uploads.validate_uploads(v.uploads().withColumn("picture", uploads.read_picture(F.unhex("content_hex"))))


@query("s1_upload_validation")
def _(v):
    return _checked_uploads(v).select("sheet_id", "image_format", "error_code", "error_message")


@query("s1a_content_type")
def _(v):
    return v.uploads().select(
        "sheet_id",
        uploads.clean_content_type(c("content_type")).alias("content_type"),
        uploads.content_type_ok(c("content_type"), c("filename")).alias("accepted"),
    )


@query("s1b_error_details")
def _(v):
    errors = _checked_uploads(v).filter(c("error_code").isNotNull()).select("sheet_id", "error_code")
    return uploads.with_error_details(errors)


@query("s2_ocr_boxes")
def _(v):
    return v.boxes_once()


@query("s3_roster_intake")
def _(v):
    snake = F.struct("student_id", "roll_number", "name", "enrollment_number", "email", "gender", "status", "remarks", F.lit(1).alias("extra"))
    camel = F.struct(
        c("student_id").alias("studentId"), c("roll_number").alias("rollNumber"), "name",
        c("enrollment_number").alias("enrollmentNumber"), "email", "gender",
    )
    lines = v.roster().select(
        *rosters.KEYS, F.when(c("roster_seq") % 2 == 0, F.to_json(snake)).otherwise(F.to_json(camel)).alias("payload")
    )
    return rosters.split_roster(rosters.parse_roster_json(lines))[0]


def _untidy(v: Inputs) -> DataFrame:
    """Records with statuses and confidences that may break the contract."""
    k = c("rec_seq") % 8
    return v.records().withColumns(
        {
            "status": F.when(k == 0, "late").when(k == 1, " 17 ").when(k == 2, "Status.ABSENT").otherwise(c("status")),
            "confidence": F.when(k == 3, F.lit(None)).when(k == 4, c("confidence") + 0.5).otherwise(c("confidence")),
        }
    )


@query("s4_record_intake")
def _(v):
    return records.split_records(_untidy(v), KEYS)[0]


@query("p5_record_quarantine")
def _(v):
    return records.split_records(_untidy(v), KEYS)[1].select(*KEYS, "status", "quarantine_reason")


@query("s5_page_roster")
def _(v):
    k = c("roster_seq") % 3
    attributes = F.concat(
        F.lit('<tr id="row-'), c("student_id"), F.lit('" data-student-row="true" data-student-id="'), c("student_id"),
        F.lit('" data-roll-number="'), F.coalesce("roll_number", F.lit("")), F.lit('" data-student-name="'), c("name"), F.lit('">'),
    )
    # The state of the row counts where the control has none.
    stated = F.concat(F.regexp_replace(attributes, ">$", ""), F.lit(' data-attendance-state="'), F.lower("status"), F.lit('">'))
    by_cell = F.concat(
        F.lit('<tr data-student-row="true" class="r"><td data-field="student-id"> '), c("student_id"),
        F.lit(' </td><td data-field="roll-number">'), F.coalesce("roll_number", F.lit("")),
        F.lit('</td><td data-field="student-name"><b class="student-name-text"><b>'), F.regexp_replace("name", " ", "</b> <b>"), F.lit("</b></b></td>"),
    )
    # Options with values, options that only have a text, and an empty one that is chosen.
    chosen = lambda s: F.when(c("status") == s, " selected").otherwise("")
    valued = [F.concat(F.lit(f'<option data-hint="not selected" value="{s}"'), chosen(s), F.lit(f">{s.title()}</option>")) for s in STATUSES]
    worded = [F.concat(F.lit("<option"), chosen(s), F.lit(f"> {s.title()} </option>")) for s in STATUSES]
    options = F.when(k == 0, F.concat(*valued)).when(k == 1, F.concat(*worded)).otherwise('<option value="PRESENT">P</option><option value="" selected>-</option>')
    control = F.concat(
        F.lit('<td><select data-attendance-control="true">'), options,
        F.lit('</select></td><td><input class="remarks-input" value="'), F.regexp_replace("remarks", " ", "&#x20;"), F.lit('"></td></tr>'),
    )
    other = F.lit('<table id="other"><tr data-student-row="true" data-student-id="X1"><td>X</td></tr></table>')
    row = F.when(k == 0, by_cell).when(k == 1, attributes).otherwise(stated)
    html = F.concat(other, F.lit('<table id="attendance-table"><tbody id="attendance-table-body">'), row, control, F.lit("</tbody></table>"), other)
    saved = v.roster().select(c("roster_seq").alias("page_id"), html.alias("html"))
    found = v.table("pages").select((-1 - c("page_id")).alias("page_id"), "html")
    return pages.roster_from_pages(saved.unionByName(found))


@query("s6_session_metadata")
def _(v):
    return sessions.session_metadata(v.sessions())


@query("s7_match_documents")
def _(v):
    return sinks.as_json(v.match().summary, "scope_id")


@query("s7_result_documents")
def _(v):
    return documents.match_documents(v.match())


@query("s7_extraction_documents")
def _(v):
    good = cells.contracted(v.extracted())
    return documents.extraction_documents(good, tallies.attendance_summary(good))


# --- predicates -----------------------------------------------------------------------


@query("p1_readable_boxes")
def _(v):
    return ocr.drop_unreadable(v.polygons()).select("sheet_id", "box_seq", "text", "conf")


@query("p2_boxes_in_table")
def _(v):
    return rows.boxes_in_table(v.boxes(), v.layouts()).select("sheet_id", "box_seq", "text")


@query("p3_row_validation")
def _(v):
    return cells.validated(v.raw_rows()).select("sheet_id", "row_index", "reject_reason")


@query("p4_identified_rows")
def _(v):
    return cells.records_from_rows(v.raw_rows()).select("sheet_id", "row_index")


@query("p6_low_confidence")
def _(v):
    return v.good_records().filter(c("confidence") < MatchConfig().review_below).select(*KEYS, "confidence")


@query("p7_student_search")
def _(v):
    return report.search_students(v.roster(), "  RING").select("scope_id", "roster_seq", "student_id", "name")


@query("p8_no_attendance")
def _(v):
    sheets = v.table("orders").select(c("o_orderkey").alias("sheet_id"))
    return uploads.with_error_details(uploads.sheets_without_records(sheets, v.extracted().select("sheet_id")))


@query("p9_status_guard")
def _(v):
    return v.roster().select("roster_seq", apply.guarded_status(c("status")).alias("status"))


# --- layout ----------------------------------------------------------------------------


@query("g1_header_candidates")
def _(v):
    return regions.header_candidates(v.boxes_once()).select("sheet_id", "box_seq", "col_type")


@query("g2_header_band")
def _(v):
    band = regions.header_band(v.boxes())
    return band.select("sheet_id", c("types").cast("bigint").alias("types"), "boxes", "top", "bottom")


@query("g3_body_top")
def _(v):
    return v.tops().select("sheet_id", "header_min_y", "header_max_y", "body_top")


@query("g4_body_bottom")
def _(v):
    return regions.with_body_bottom(v.tops(), v.telling()).select("sheet_id", "body_bottom")


@query("g5_body_sides")
def _(v):
    return regions.page_layouts(v.ends(), v.boxes(), telling=v.telling()).select("sheet_id", "body_left", "body_right")


@query("g6_g7_g8_columns")
def _(v):
    layouts = regions.page_layouts(v.ends(), v.boxes(), telling=v.telling())
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("col_type"), c("columns")[k].alias("col")) for k in COLUMN_TYPES]))
    return (
        layouts.select("sheet_id", each.alias("e"))
        .filter(c("e.col").isNotNull())
        .select("sheet_id", "e.col_type", "e.col.low", "e.col.high", "e.col.cx", "e.col.header_text")
    )


@query("g9_row_anchors")
def _(v):
    return rows.row_anchors(v.telling(), v.layouts())


@query("g10_distinct_anchors")
def _(v):
    return rows.distinct_anchors(v.anchors())


@query("g11_row_bands")
def _(v):
    return rows.row_bands(rows.distinct_anchors(v.anchors())).select(
        "sheet_id", c("row_index").cast("bigint").alias("row_index"), "cy", "y_start", "y_end"
    )


@query("g12_boxes_to_bands")
def _(v):
    body = rows.boxes_in_table(v.boxes(), v.layouts())
    return rows.boxes_to_bands(body, v.bands()).select("sheet_id", "box_seq", c("row_index").cast("bigint").alias("row_index"))


@query("g13_boxes_to_clusters")
def _(v):
    banded = v.bands().select("sheet_id").distinct()
    body = rows.boxes_in_table(v.boxes(), v.layouts().join(banded, "sheet_id", "left_anti"))
    found = rows.clusters_in_order(rows.boxes_to_clusters(body))
    return found.select("sheet_id", "box_seq", c("row_index").cast("bigint").alias("row_index"))


@query("g14_boxes_to_cells")
def _(v):
    return v.placed().select(
        "sheet_id", "box_seq", c("row_index").cast("bigint").alias("row_index"), "cell"
    )


@query("g15_g16_cell_texts")
def _(v):
    return v.line_texts().withColumn("row_index", c("row_index").cast("bigint"))


@query("g17_records")
def _(v):
    good = cells.records_from_rows(v.raw_rows())
    return good.withColumn("row_index", c("row_index").cast("bigint"))


@query("g18_extracted_records")
def _(v):
    good, _rejected = extract.extract(v.boxes())
    return good.withColumn("rec_seq", c("rec_seq").cast("bigint"))


# --- matching ----------------------------------------------------------------------------


@query("j0_roster_index")
def _(v):
    return lookups.roster_index(v.roster()).select(
        "scope_id", "step", "match_key", "holders", c("student.student_id").alias("last_student_id")
    )


def _one_step(name: str, step: int) -> None:
    @query(name)
    def _(v: Inputs):
        return _flat(matching.resolve_one_step(v.good_records(), v.roster(), step))


_one_step("j1_match_student_id", lookups.BY_STUDENT_ID)
_one_step("j2_match_roll", lookups.BY_ROLL)
_one_step("j3_match_roll_number", lookups.BY_ROLL_NUMBER)
_one_step("j4_match_enrollment", lookups.BY_ENROLLMENT)
_one_step("j5_match_exact_name", lookups.BY_NAME)
_one_step("j6_match_normalized_name", lookups.BY_NORMAL_NAME)


@query("j7_fuzzy_students")
def _(v):
    return fuzzy.fuzzy_students(v.open_names(), v.roster()).select("scope_id", "norm_name", "roster_seq", "student_id", "score")


@query("j8_fuzzy_decisions")
def _(v):
    decided = fuzzy.decide(fuzzy.top_candidates(v.open_names(), v.roster()))
    return decided.select(
        "scope_id", "norm_name", "candidates_count", "best", c("student.student_id").alias("student_id"),
        "resolution", "match_confidence", "review_reason",
    )


@query("j9_cascade")
def _(v):
    found = matching.find_exact(v.good_records(), v.roster())
    return _flat(matching.resolve_exact(found))


@query("j9_cascade_with_fuzzy")
def _(v):
    return _flat(reconcile.resolve(v.good_records(), v.roster())[0])


@query("j10_unmatched")
def _(v):
    results = v.match().results
    return results.filter(c("resolution") == "UNMATCHED").select(*KEYS, "match_method", "match_confidence", "review_reason")


@query("j11_raw_student_id")
def _(v):
    return v.match().results.select(*KEYS, "raw_student_id")


@query("j12_missing_students")
def _(v):
    resolved, _ = reconcile.resolve(v.good_records(), v.roster())
    return matching.missing_students(v.roster(), matching.first_seen(resolved)).select("scope_id", "roster_seq", "student_id", "name")


@query("j13_apply_cascade")
def _(v):
    return apply.apply_targets(v.roster_rows(), v.approved()).select(*KEYS, "roster_seq", "final_status", "reason")


@query("j13_apply_by_id")
def _(v):
    return apply.apply_targets_by_id(v.roster_rows(), v.approved()).select(*KEYS, "roster_seq", "final_status", "reason")


@query("j13_apply_by_id_counting_unknown")
def _(v):
    targets = apply.apply_targets_by_id(v.roster_rows(), v.approved(), count_unknown=True)
    return targets.select(*KEYS, "roster_seq", "final_status", "reason")


@query("j14_missing_controls")
def _(v):
    targets = apply.apply_targets(v.roster_rows(), v.approved())
    return targets.filter(c("reason") == apply.NO_CONTROL).select(*KEYS, "roster_seq")


@query("w1_w2_repeats")
def _(v):
    resolved = stage(reconcile.resolve(v.good_records(), v.roster())[0])
    flagged = matching.flag_repeats(resolved, matching.first_seen(resolved))
    return flagged.select(*KEYS, "is_duplicate", "is_conflict", "resolution", "review_reason")


@query("w3_fuzzy_candidates")
def _(v):
    top = fuzzy.top_candidates(v.open_names(), v.roster())
    return top.select(
        "scope_id", "norm_name", c("rank").cast("bigint").alias("rank"), "student_id", numeric.round2(c("score")).alias("similarity")
    )


@query("j_candidate_lists")
def _(v):
    """Every candidate behind every shared key, however long the list."""
    return v.match().candidates.select("scope_id", "match_step", "candidate_key", "position", "student_id", "roll_number", "name", "similarity")


@query("w4_candidate_previews")
def _(v):
    m = v.match()
    return report.review_previews(m.results, m.candidates).select(*KEYS, "preview")


@query("w5_missing_in_order")
def _(v):
    return v.match().missing.orderBy("scope_id", "roll_order", "student_id").select("scope_id", "roll_order", "student_id")


@query("w6_results_in_order")
def _(v):
    return v.match().results.orderBy(*KEYS).select(*KEYS, "match_method", "resolution")


# --- tallies, exceptions, report ------------------------------------------------------------


@query("a1_attendance_summary")
def _(v):
    return tallies.attendance_summary(v.extracted())


@query("a2_match_summary")
def _(v):
    return v.match().summary


@query("a3_roster_tally")
def _(v):
    return tallies.roster_tally(v.roster())


@query("a4_report_tally")
def _(v):
    m = v.match()
    return tallies.report_tally(m.results, m.exceptions)


@query("a5_apply_summary")
def _(v):
    return apply.apply_summary(apply.apply_targets(v.roster_rows(), v.approved()))


@query("a6_apply_issues")
def _(v):
    scopes = v.sessions().select((c("scope_id") * 2).alias("scope_id"))
    return tallies.apply_issues(v.roster(), scopes).select("scope_id", "is_valid", F.array_join("issues", "; ").alias("issues"))


def _submissions(v: Inputs) -> DataFrame:
    taught = sessions.session_metadata(v.sessions())
    return tallies.session_submissions(v.roster(), taught)


@query("a7_session_submissions")
def _(v):
    return _submissions(v)


@query("s8_session_history")
def _(v):
    return report.history_listing(_submissions(v)).select("session_id", "date_formatted", "class_name", "present", "absent")


@query("s8_appended_history")
def _(v):
    """History after three submissions, one of them sent twice and one that never committed."""
    rows, folder = _submissions(v), f"{shared_folder(v.spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    for n in (0, 1, 1, 2):
        history.append_history(rows.filter(c("session_id") % 3 == n), folder, f"batch-{n}")
    rows.withColumn("submission_id", F.lit("lost")).write.parquet(f"{folder}/rows/attempt=lost")
    return history.read_history(v.spark, folder).select("submission_id", "session_id", "total_students", "present", "submitted_by")


@query("s6_class_and_subject")
def _(v):
    known = sessions.with_class_and_subject(v.sessions(), v.classes(), v.subjects())
    return known.select("session_id", "class_id", "class_label", "class_section", "subject_code", "subject_label")


@query("r4_subject_listing")
def _(v):
    return report.subject_listing(v.subjects())


@query("e_exceptions")
def _(v):
    d = lambda key: c("details")[key].alias(key)
    keys = ("ai_confidence", "detected_status", "previous_status", "current_status", "raw_name", "raw_identifier", "candidates_count")
    return v.match().exceptions.select(
        "scope_id", "phase", "seq", "nth", "type", "student_id", "name", "message", *[d(k) for k in keys]
    )


@query("r1_review_rows")
def _(v):
    return report.review_rows(v.match().results)


@query("r2_exception_rows")
def _(v):
    return report.exception_rows(v.match().exceptions).select("scope_id", "seq", "label")


@query("r3_sheet_only_rows")
def _(v):
    return report.sheet_only_rows(v.good_records(), v.roster().filter(c("scope_id") % 3 != 1))


@query("r4_roster_listing")
def _(v):
    return report.roster_listing(v.roster(), "bolt")


# --- roster updates ---------------------------------------------------------------------------


@query("m1_apply_statuses")
def _(v):
    table = v.roster_rows()
    return apply.updated_rows(table, apply.apply_targets(table, v.approved())).select(
        "scope_id", "roster_seq", "student_id", "status", "remarks", "modified"
    )


@query("m1_roster_versions")
def _(v):
    """The roster before and after the statuses of some classes were applied to its buckets."""
    store = RosterVersions(v.spark, f"{shared_folder(v.spark).rstrip('/')}/roster-{uuid.uuid4().hex}", 16)
    first = store.create(v.roster_rows().withColumn("modified", F.lit(False)))
    approved = stage(v.approved().filter(c("scope_id") % 4 == 1))
    second = store.update(approved.select("scope_id"), lambda rows: apply.updated_rows(rows, apply.apply_targets(rows, approved)))
    columns = [F.lit(n).alias("version") for n in (first, second)]
    shown = [store.read(n).select(k, "scope_id", "roster_seq", "status", "remarks", "modified") for n, k in zip((first, second), columns)]
    return shown[0].unionByName(shown[1])


@query("m2_change_statuses")
def _(v):
    return apply.change_statuses(v.roster(), v.approved()).select("scope_id", "roster_seq", "status", "modified")


@query("m3_bulk_statuses")
def _(v):
    return apply.set_all_statuses(v.roster(), PRESENT, c("scope_id") % 2 == 0).select("roster_seq", "status", "modified")


@query("m4_session_rows")
def _(v):
    return apply.new_session_rows(v.roster())



