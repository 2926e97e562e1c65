"""The queries once more in SQL, for DuckDB over the same tables.

Written from the rules, with other means than the Spark side where there are any:
all-pairs joins, windows, list folds and a recursive string match instead of
blocks, pre-aggregation, streamed state and a library score.
"""

from __future__ import annotations

from rollkeeper import testdata
from rollkeeper.functions import headers, marks
from rollkeeper.plans.registry import IDENTITIES

_TABLES = {t: t for t in ("customer", "part", "orders", "lineitem", "events", "nation", "region", "roster", "line_boxes", "page_boxes")}


def _view(text: str) -> str:
    return text.format(**_TABLES, **testdata.DUCKDB_DIALECT)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def digits(x: str) -> str:
    return f"nullif(regexp_extract({x}, '\\b([0-9]+)\\b', 1), '')"


def unpadded(x: str) -> str:
    return f"regexp_replace({x}, '^0+([0-9])', '\\1')"


def zero_stripped(x: str) -> str:
    return f"regexp_replace({x}, '^0+', '')"


def round2(x: str) -> str:
    """Half-even on the exact binary value, through the exact error of x * 200."""
    v = f"CAST({x} AS DOUBLE)"
    hi = f"((134217729e0 * {v}) - ((134217729e0 * {v}) - {v}))"
    err = f"(({hi} * 200e0 - {v} * 200e0) + (({v} - {hi}) * 200e0))"
    n = f"CAST(floor({v} * 200e0) AS BIGINT)"
    h = f"({n} // 2)"
    return (
        f"(CASE WHEN {n} % 2 = 0 THEN {h} WHEN {v} * 200e0 > {n} OR {err} > 0 THEN {h} + 1 "
        f"WHEN {err} < 0 THEN {h} ELSE {h} + {h} % 2 END) / 100e0"
    )


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _shown_date(x: str) -> str:
    """A date as listed, by its parts; what is missing or no number shows as such."""
    number = lambda n: f"coalesce(CAST(TRY_CAST(regexp_extract(split_part({x}, '-', {n}), '^\\s*([0-9]+)', 1) AS BIGINT) AS VARCHAR), 'NaN')"
    part = lambda n: f"CASE WHEN len(string_split({x}, '-')) >= {n} THEN split_part({x}, '-', {n}) ELSE 'undefined' END"
    months = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
    return (
        f"CASE WHEN coalesce({x}, '') = '' THEN '26 Sep 2026' ELSE concat({number(3)}, ' ', "
        f"coalesce({months}[TRY_CAST({number(2)} AS BIGINT)], 'Sep'), ' ', {part(1)}) END"
    )


def _marks(mark: str, in_column: str) -> str:
    """status, conf and mark as one struct expression."""
    u = f"upper({strip(mark)})"
    raw = strip(mark)
    letters = f"regexp_replace({u}, '[^A-Za-z✓✔✗✘]', '', 'g')"
    absent, present = f"({_in(marks.ABSENT_TOKENS)})", f"({_in(marks.PRESENT_TOKENS)})"
    number = f"regexp_extract({raw}, '^#?([0-9]+)\\.?$', 1)"
    s = lambda status, conf, m: f"{{'status': '{status}', 'conf': {conf}e0, 'mark': {m}}}"
    return (
        f"CASE WHEN {mark} IS NULL OR {raw} = '' THEN {s('ABSENT', 0.40, chr(39) * 2)} "
        f"WHEN {u} IN {absent} OR {u} = '0' THEN {s('ABSENT', 0.98, raw)} "
        f"WHEN {letters} IN {absent} THEN {s('ABSENT', 0.96, raw)} "
        f"WHEN {u} IN {present} THEN {s('PRESENT', 0.98, raw)} "
        f"WHEN {letters} IN {present} THEN {s('PRESENT', 0.96, raw)} "
        f"WHEN {in_column} AND regexp_full_match({raw}, '[0-9]*[1-9][0-9]*') THEN {s('PRESENT', 0.97, raw)} "
        f"WHEN {in_column} AND regexp_full_match({number}, '[0-9]*[1-9][0-9]*') THEN {s('PRESENT', 0.95, number)} "
        f"WHEN {in_column} AND {number} <> '' THEN {s('ABSENT', 0.95, chr(39) + '0' + chr(39))} "
        f"WHEN {in_column} AND {u} IN ('I','L','|','/') THEN {s('PRESENT', 0.60, raw)} "
        f"WHEN {in_column} AND {u} IN ('O','D') THEN {s('ABSENT', 0.55, raw)} "
        f"ELSE {s('ABSENT', 0.45, raw)} END"
    )


def _strict(x: str) -> str:
    u = f"upper({strip(x)})"
    return (
        f"CASE WHEN {u} IN ({_in(marks.STRICT_PRESENT)}) OR {u} LIKE '%.PRESENT' THEN 'PRESENT' "
        f"WHEN {u} IN ({_in(marks.STRICT_ABSENT)}) OR {u} LIKE '%.ABSENT' THEN 'ABSENT' "
        f"WHEN regexp_full_match({u}, '[0-9]*[1-9][0-9]*') THEN 'PRESENT' END"
    )


def _is_metadata(x: str) -> str:
    return f"regexp_full_match(lower({x}), '{headers.METADATA}')"


def _is_banner(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in headers.BANNER_WORDS) + ")"


def _header_type(x: str) -> str:
    t = f"lower({x})"
    arms = []
    for kind, ws in headers.HEADER_KEYWORDS.items():
        tests = [f"starts_with({t}, '{w}') OR list_contains(regexp_split_to_array({t}, '\\s+'), '{w}')" for w in ws]
        arms.append(f"WHEN {' OR '.join(tests)} THEN '{kind}'")
    return f"CASE {' '.join(arms)} END"


# --- named parts; each lists the parts it reads ------------------------------------------------

_SHAPE = "STU[0-9]+|[A-Z]{2,4}[0-9]{2,5}"
_COLS = ("ROLL_NO", "STUDENT_ID", "NAME", "ATTENDANCE")

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "roster": ((), _view(testdata.ROSTER)),
    "records": (("roster",), _view(testdata.RECORDS)),
    "marks": ((), _view(testdata.MARKS)),
    "line_boxes": ((), _view(testdata.LINE_BOXES)),
    "page_boxes": ((), _view(testdata.PAGE_BOXES)),
    "ocr": (("line_boxes", "page_boxes"), _view(testdata.OCR_RAW)),
    "uploads": ((), _view(testdata.UPLOADS)),
    "sessions": ((), _view(testdata.SESSIONS)),
    "classes": ((), _view(testdata.CLASSES)),
    "subjects": ((), _view(testdata.SUBJECTS)),
    "identities": ((), _view(IDENTITIES)),
    "prices": (
        (),
        "SELECT o_orderkey, o_totalprice / 600000e0 AS x, (o_orderkey % 2000) / 2000e0 AS y FROM orders",
    ),
    "good": (
        ("records",),
        f"SELECT scope_id, rec_seq, raw_name, raw_identifier, raw_student_id, raw_attendance_mark, status, "
        f"{round2('confidence')} AS confidence FROM records WHERE confidence BETWEEN 0 AND 1",
    ),
    "boxes": (
        ("ocr",),
        f"SELECT sheet_id, box_seq, {strip('text')} AS text, conf, x0 AS min_x, x1 AS max_x, y0 AS min_y, y1 AS max_y, "
        f"img_w, img_h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(x1 - x0, 6e0) AS w, greatest(y1 - y0, 6e0) AS h "
        f"FROM ocr WHERE conf >= 0.15 AND {strip('text')} <> ''",
    ),
    # layout
    "cands": (
        ("boxes",),
        f"SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY cy, box_seq) AS nth FROM "
        f"(SELECT *, {_header_type('text')} AS col_type FROM boxes WHERE NOT {_is_metadata('text')} AND NOT {_is_banner('text')}) "
        f"WHERE col_type IS NOT NULL",
    ),
    "band_of": (
        ("cands",),
        "SELECT i.sheet_id, i.nth, count(DISTINCT j.col_type) AS types, count(*) AS boxes, min(j.min_y) AS top, max(j.max_y) AS bottom "
        "FROM cands i JOIN cands j ON i.sheet_id = j.sheet_id AND abs(i.cy - j.cy) <= greatest(i.h, j.h, 30) GROUP BY ALL",
    ),
    "header": (
        ("band_of",),
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY types DESC, boxes DESC, nth) AS r FROM band_of) "
        "WHERE r = 1 AND types >= 2",
    ),
    "tops": (
        ("boxes", "header"),
        f"SELECT s.sheet_id, s.img_w, s.img_h, h.top AS header_min_y, h.bottom AS header_max_y, "
        f"coalesce(h.bottom + 2, s.a - 5, 0e0) AS body_top FROM (SELECT sheet_id, max(img_w) AS img_w, max(img_h) AS img_h, "
        f"min(min_y) FILTER (WHERE regexp_full_match(text, '(?i)00[0-9]|[0-9]{{1,3}}|STU[0-9]+') AND min_x < img_w * 0.4 AND NOT {_is_metadata('text')}) AS a "
        f"FROM boxes GROUP BY sheet_id) s LEFT JOIN header h USING (sheet_id)",
    ),
    "ends": (
        ("tops", "boxes"),
        "SELECT t.*, coalesce(f.body_bottom, t.img_h) AS body_bottom FROM tops t LEFT JOIN (SELECT b.sheet_id, "
        "list_reduce(list(b.min_y ORDER BY b.box_seq), lambda e, y: CASE WHEN y < e THEN y - 5 ELSE e END, any_value(t.img_h)) AS body_bottom "
        "FROM boxes b JOIN tops t USING (sheet_id) WHERE b.cy > t.body_top AND (contains(lower(text), 'sign') OR contains(lower(text), 'total present') "
        "OR contains(lower(text), 'total absent') OR contains(lower(text), 'total:')) GROUP BY b.sheet_id) f USING (sheet_id)",
    ),
    "sides": (
        ("ends", "boxes"),
        "SELECT e.*, coalesce(greatest(m.lo - 25, 0), 0e0) AS body_left, coalesce(least(m.hi + 25, img_w), img_w) AS body_right FROM ends e "
        "LEFT JOIN (SELECT b.sheet_id, min(b.min_x) AS lo, max(b.max_x) AS hi FROM boxes b JOIN ends e USING (sheet_id) "
        "WHERE b.cy BETWEEN e.body_top - 30 AND e.body_bottom GROUP BY b.sheet_id) m USING (sheet_id)",
    ),
    "heads": (
        ("header", "cands"),
        "SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.sheet_id, c.col_type ORDER BY c.min_x, c.nth <> h.nth, c.nth) AS r "
        "FROM header h JOIN cands i ON i.sheet_id = h.sheet_id AND i.nth = h.nth "
        "JOIN cands c ON c.sheet_id = h.sheet_id AND abs(c.cy - i.cy) <= greatest(c.h, i.h, 30)) WHERE r = 1",
    ),
    "head_cols": (
        ("heads",),
        "SELECT sheet_id, col_type, cx, text AS header_text, row_number() OVER w AS place, "
        "coalesce((lag(max_x) OVER w + min_x) / 2, 0e0) AS low, coalesce((max_x + lead(min_x) OVER w) / 2, img_w) AS high "
        "FROM heads WINDOW w AS (PARTITION BY sheet_id ORDER BY cx, min_x)",
    ),
    "ids": (
        ("sides", "boxes", "head_cols"),
        "SELECT b.sheet_id, avg(b.cx) AS cx, min(b.min_x) - 15 AS low, max(b.max_x) + 15 AS high FROM boxes b JOIN sides s USING (sheet_id) "
        "WHERE b.cy BETWEEN s.body_top AND s.body_bottom AND regexp_full_match(b.text, '(?i)STU[0-9]+') AND b.sheet_id IN ("
        "SELECT sheet_id FROM head_cols GROUP BY sheet_id HAVING bool_or(col_type = 'ROLL_NO') AND bool_or(col_type = 'NAME') "
        "AND NOT bool_or(col_type = 'STUDENT_ID')) GROUP BY b.sheet_id",
    ),
    "cols": (
        ("head_cols", "ids", "sides"),
        "SELECT h.sheet_id, h.col_type, CASE WHEN h.col_type = 'NAME' THEN coalesce(i.high, h.low) ELSE h.low END AS low, "
        "CASE WHEN h.col_type = 'ROLL_NO' THEN coalesce(i.low, h.high) ELSE h.high END AS high, h.cx, h.header_text, h.place "
        "FROM head_cols h LEFT JOIN ids i USING (sheet_id) "
        "UNION ALL SELECT sheet_id, 'STUDENT_ID', low, high, cx, 'Student ID', 9 FROM ids "
        "UNION ALL SELECT sheet_id, g.t, img_w * g.lo, img_w * g.hi, img_w * g.mid, g.txt, g.n FROM sides, "
        "(VALUES ('ROLL_NO', 0e0, 0.2e0, 0.1e0, 'Roll No', 1), ('STUDENT_ID', 0.2e0, 0.4e0, 0.3e0, 'Student ID', 2), "
        "('NAME', 0.4e0, 0.75e0, 0.575e0, 'Student Name', 3), ('ATTENDANCE', 0.75e0, 1e0, 0.875e0, 'Attendance', 4)) AS g(t, lo, hi, mid, txt, n) "
        "WHERE sheet_id NOT IN (SELECT sheet_id FROM head_cols)",
    ),
    "body": (
        ("boxes", "sides"),
        f"SELECT b.* FROM boxes b JOIN sides s USING (sheet_id) WHERE b.cy BETWEEN s.body_top AND s.body_bottom "
        f"AND b.cx BETWEEN s.body_left - 10 AND s.body_right + 10 AND NOT {_is_metadata('b.text')} AND NOT {_is_banner('b.text')} "
        f"AND NOT (b.text IN ('_','-','--','---','|','—','=') AND b.w > 50) AND b.h >= 5",
    ),
    "anchors": (
        ("body", "cols"),
        "SELECT DISTINCT b.sheet_id, b.cy FROM body b JOIN cols c ON c.sheet_id = b.sheet_id AND b.cx BETWEEN c.low - 10 AND c.high + 10 "
        "WHERE (c.col_type = 'ROLL_NO' AND regexp_full_match(b.text, '(?i)[0-9]{1,4}|STU[0-9]+|#[0-9]+|[A-Z]{1,3}[0-9]{1,4}')) "
        "OR (c.col_type = 'STUDENT_ID' AND regexp_full_match(b.text, '(?i)STU[0-9]+|[A-Z]{2,4}[0-9]{2,4}'))",
    ),
    "kept": (
        ("anchors",),
        "SELECT sheet_id, unnest(list_reduce(list(cy ORDER BY cy), lambda k, y: CASE WHEN len(k) = 0 OR y - k[len(k)] > 16 "
        "THEN list_append(k, y) ELSE k END, []::DOUBLE[])) AS cy FROM anchors GROUP BY sheet_id",
    ),
    "bands": (
        ("kept",),
        "SELECT sheet_id, n AS row_index, cy, CASE WHEN a IS NULL THEN cy - (z - cy) / 2 ELSE (a + cy) / 2 END AS y_start, "
        "CASE WHEN z IS NULL THEN cy + (cy - a) / 2 ELSE (cy + z) / 2 END AS y_end FROM (SELECT *, row_number() OVER w AS n, "
        "lag(cy) OVER w AS a, lead(cy) OVER w AS z FROM kept WINDOW w AS (PARTITION BY sheet_id ORDER BY cy)) WHERE a IS NOT NULL OR z IS NOT NULL",
    ),
    "in_bands": (
        ("body", "bands"),
        "SELECT sheet_id, box_seq, row_index FROM (SELECT b.sheet_id, b.box_seq, r.row_index, row_number() OVER (PARTITION BY b.sheet_id, b.box_seq "
        "ORDER BY b.cy NOT BETWEEN r.y_start AND r.y_end, CASE WHEN b.cy BETWEEN r.y_start AND r.y_end THEN 0 ELSE abs(b.cy - r.cy) END, r.row_index) AS k, "
        "b.cy BETWEEN r.y_start AND r.y_end OR abs(b.cy - r.cy) <= (r.y_end - r.y_start) * 0.9e0 AS ok "
        "FROM body b JOIN bands r USING (sheet_id)) WHERE k = 1 AND ok",
    ),
    "folded": (
        ("body", "bands"),
        "SELECT sheet_id, list_reduce(list({'s': box_seq, 'y': cy, 'a': min_x, 'b': max_x} ORDER BY cy, box_seq), lambda rs, x: "
        "CASE WHEN len(list_filter(rs, lambda r: abs(x.y - r.t / r.n) <= any_reach AND NOT list_bool_or(list_transform(r.m, lambda p: greatest(p.a, x.a) < least(p.b, x.b) - 8)))) = 0 "
        "THEN list_append(rs, {'k': len(rs) + 1, 't': x.y, 'n': 1, 'm': [x]}) "
        "ELSE list_transform(rs, lambda r: CASE WHEN r.k = list_sort(list_transform(list_filter(rs, lambda r2: abs(x.y - r2.t / r2.n) <= any_reach AND NOT "
        "list_bool_or(list_transform(r2.m, lambda p: greatest(p.a, x.a) < least(p.b, x.b) - 8))), lambda r3: {'d': abs(x.y - r3.t / r3.n), 'k': r3.k}))[1].k "
        "THEN {'k': r.k, 't': r.t + x.y, 'n': r.n + 1, 'm': list_append(r.m, x)} ELSE r END) END, "
        "[]::STRUCT(k BIGINT, t DOUBLE, n BIGINT, m STRUCT(s BIGINT, y DOUBLE, a DOUBLE, b DOUBLE)[])[]) AS rs "
        "FROM (SELECT b.*, least(greatest(median(h) OVER (PARTITION BY sheet_id) * 0.7e0, 12), 22) AS any_reach FROM body b "
        "WHERE sheet_id NOT IN (SELECT sheet_id FROM bands)) GROUP BY sheet_id, any_reach",
    ),
    "in_clusters": (
        ("folded",),
        "SELECT sheet_id, unnest(m).s AS box_seq, row_index FROM (SELECT sheet_id, r.m AS m, row_number() OVER (PARTITION BY sheet_id ORDER BY r.t / r.n, r.k) AS row_index "
        "FROM (SELECT sheet_id, unnest(rs) AS r FROM folded))",
    ),
    "placed": (
        ("in_bands", "in_clusters", "body"),
        "SELECT b.*, p.row_index FROM (SELECT * FROM in_bands UNION ALL SELECT * FROM in_clusters) p JOIN body b USING (sheet_id, box_seq)",
    ),
    "celled": (
        ("placed", "cols"),
        "SELECT * FROM (SELECT p.*, c.col_type AS cell, row_number() OVER (PARTITION BY p.sheet_id, p.box_seq ORDER BY p.cx NOT BETWEEN c.low AND c.high, "
        "CASE WHEN p.cx NOT BETWEEN c.low AND c.high THEN abs(p.cx - c.cx) ELSE list_position(['ATTENDANCE', 'ROLL_NO', 'STUDENT_ID', 'NAME'], c.col_type) END, "
        "c.low) AS k FROM placed p JOIN cols c USING (sheet_id)) WHERE k = 1",
    ),
    "texts": (
        ("celled",),
        "SELECT sheet_id, row_index, "
        + ", ".join(f"nullif(trim(string_agg(text, ' ' ORDER BY min_x, cy, box_seq) FILTER (WHERE cell = '{k}')), '') AS {k}" for k in _COLS)
        + ", CAST(sum(CAST(conf AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS row_confidence FROM celled GROUP BY sheet_id, row_index",
    ),
    "split_one": (
        ("texts",),
        "SELECT sheet_id, row_index, regexp_replace(regexp_replace(ROLL_NO, '^0[oOuU]([0-9])$', '00\\1'), '^0[oOuU]([0-9]{2})$', '0\\1') AS roll, "
        "STUDENT_ID AS sid, NAME AS name, ATTENDANCE AS mark, row_confidence FROM texts",
    ),
}


def _split_identity(source: str, keys: str, roll: str, sid: str, name: str, rest: str) -> str:
    named = f"CASE WHEN coalesce({sid}, '') = '' THEN nullif(regexp_extract({name}, '(?i)\\b({_SHAPE})\\b', 1), '') END"
    one = (
        f"SELECT {keys}, {roll} AS roll, {rest} coalesce(upper({named}), {sid}) AS sid, CASE WHEN {named} IS NOT NULL "
        f"THEN trim(regexp_replace({name}, '(?i)\\b({_SHAPE})\\b', ''), ' |,-') ELSE {name} END AS name FROM {source}"
    )
    both = f"regexp_extract(roll, '(?i)^([0-9]{{1,4}})\\s+({_SHAPE})$', 2)"
    return (
        f"SELECT {keys}, {rest} CASE WHEN {both} <> '' THEN regexp_extract(roll, '^([0-9]+)', 1) ELSE roll END AS roll, "
        f"CASE WHEN {both} <> '' THEN upper({both}) WHEN coalesce(sid, '') = '' AND regexp_full_match(roll, '(?i){_SHAPE}') THEN upper(roll) "
        f"ELSE sid END AS sid, name FROM ({one})"
    )


def _repair_sid(x: str) -> str:
    p = f"upper(regexp_extract({x}, '^([A-Za-z]+)', 1))"
    k = f"least(length(regexp_extract({p}, '(O*)$', 1)), greatest(length({p}) - 3, 0))"
    return (
        f"CASE WHEN {x} IS NULL OR {p} = '' THEN {x} ELSE concat(substr({p}, 1, length({p}) - {k}), repeat('0', {k}), "
        f"translate(substr({x}, length({p}) + 1), 'oO', '00')) END"
    )


_REPAIR_NAME = "regexp_replace(regexp_replace(name, '\\$\\.', 'S.', 'g'), '\\$\\b', 'S', 'g')"

PARTS["raw_rows"] = (
    ("split_one",),
    f"SELECT sheet_id, row_index, roll AS raw_identifier, {_repair_sid('sid')} AS raw_student_id, {_REPAIR_NAME} AS raw_name, "
    f"mark AS raw_attendance_mark, row_confidence FROM ({_split_identity('split_one', 'sheet_id, row_index', 'roll', 'sid', 'name', 'mark, row_confidence,')})",
)
PARTS["made"] = (
    ("raw_rows",),
    f"SELECT sheet_id, row_index, raw_name, coalesce(raw_identifier, raw_student_id) AS raw_identifier, raw_student_id, "
    f"CASE WHEN raw_attendance_mark IS NOT NULL THEN n.mark END AS raw_attendance_mark, "
    f"CASE WHEN raw_attendance_mark IS NOT NULL THEN n.status ELSE 'ABSENT' END AS status, "
    f"CASE WHEN raw_attendance_mark IS NULL THEN 0.45e0 ELSE {round2('mixed')} END AS confidence FROM ("
    f"SELECT *, least(greatest(n.conf * 0.75e0 + row_confidence * 0.25e0, 0.40e0), 0.99e0) AS mixed FROM ("
    f"SELECT *, {_marks('raw_attendance_mark', 'true')} AS n FROM raw_rows WHERE raw_attendance_mark IS NOT NULL OR raw_identifier IS NOT NULL "
    f"OR raw_student_id IS NOT NULL OR length(raw_name) >= 2))",
)
_KEYWORD_LIST = _in(w for words in headers.HEADER_KEYWORDS.values() for w in words)


def _reject(ident: str) -> str:
    return (
        f"CASE WHEN coalesce(raw_name, '') = '' AND {ident} = '' AND coalesce(raw_student_id, '') = '' THEN 'no identity' "
        f"WHEN coalesce(raw_name, '') <> '' AND {_is_metadata('raw_name')} THEN 'page metadata' "
        f"WHEN lower(coalesce(raw_name, '')) IN ({_KEYWORD_LIST}) THEN 'header name' "
        f"WHEN lower({ident}) IN ('roll','rollno','roll no','sr','s.no','no','page','date','id') THEN 'header identifier' "
        f"WHEN {ident} = '' AND coalesce(raw_student_id, '') = '' AND (length(coalesce(raw_name, '')) <= 1 "
        f"OR raw_name IN ('.', ',', '-', '|', '/', '\\', ':', ';', '_')) THEN 'fragment' END"
    )


# matching
_IDENT = f"nullif({strip('raw_identifier')}, '')"
_SID = f"nullif({strip('raw_student_id')}, '')"
PARTS |= {
    "keyed": (
        ("good",),
        f"SELECT *, upper(coalesce({_SID}, {_IDENT})) AS k1, upper({_IDENT}) AS k2, {unpadded(digits(_IDENT))} AS k3, "
        f"nullif({strip('raw_name')}, '') AS k5, nullif({norm('raw_name')}, '') AS k6 FROM good",
    ),
    **{
        part: (
            ("roster",),
            f"SELECT scope_id, k, arg_max({{'i': student_id, 'r': roll_number, 'n': name}}, roster_seq) AS s, count(*) AS n "
            f"FROM (SELECT *, {key} AS k FROM roster) WHERE k <> '' GROUP BY scope_id, k",
        )
        for part, key in {
            "by_id": f"upper({strip('student_id')})",
            "by_roll": f"upper({strip('roll_number')})",
            "by_number": unpadded(digits("roll_number")),
            "by_enrol": f"upper({strip('enrollment_number')})",
            "by_name": strip("name"),
            "by_norm": norm("name"),
        }.items()
    },
    "hits": (
        ("keyed", "by_id", "by_roll", "by_number", "by_enrol", "by_name", "by_norm"),
        "SELECT q.*, CASE WHEN a.k IS NOT NULL THEN 1 WHEN b.k IS NOT NULL THEN 2 WHEN c.k IS NOT NULL THEN 3 WHEN d.k IS NOT NULL THEN 4 "
        "WHEN e.k IS NOT NULL THEN 5 WHEN f.k IS NOT NULL THEN 6 ELSE 0 END AS step, "
        "a.s AS s1, b.s AS s2, c.s AS s3, d.s AS s4, e.s AS s5, f.s AS s6, b.n AS n2, c.n AS n3, e.n AS n5, f.n AS n6, "
        "a.k IS NOT NULL AS h1, b.k IS NOT NULL AS h2, c.k IS NOT NULL AS h3, d.k IS NOT NULL AS h4, e.k IS NOT NULL AS h5, f.k IS NOT NULL AS h6 "
        "FROM keyed q LEFT JOIN by_id a ON a.scope_id = q.scope_id AND a.k = k1 LEFT JOIN by_roll b ON b.scope_id = q.scope_id AND b.k = k2 "
        "LEFT JOIN by_number c ON c.scope_id = q.scope_id AND c.k = k3 LEFT JOIN by_enrol d ON d.scope_id = q.scope_id AND d.k = k2 "
        "LEFT JOIN by_name e ON e.scope_id = q.scope_id AND e.k = k5 LEFT JOIN by_norm f ON f.scope_id = q.scope_id AND f.k = k6",
    ),
}
_METHODS = "['STUDENT_ID', 'ROLL_NUMBER', 'ROLL_NUMBER', 'ENROLLMENT_NUMBER', 'EXACT_NAME', 'NORMALIZED_NAME']"


def _outcome(step: str, source: str) -> str:
    holders = f"(CASE {step} WHEN 1 THEN 1 WHEN 2 THEN n2 WHEN 3 THEN n3 WHEN 4 THEN 1 WHEN 5 THEN n5 WHEN 6 THEN n6 END)"
    stu = f"(CASE WHEN {holders} = 1 THEN (CASE {step} WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 WHEN 4 THEN s4 WHEN 5 THEN s5 WHEN 6 THEN s6 END) END)"
    return (
        f"SELECT scope_id, rec_seq, CASE WHEN {step} = 1 THEN raw_student_id ELSE nullif(raw_student_id, '') END AS raw_student_id, status, "
        f"confidence AS ai_confidence, CASE WHEN {step} = 0 THEN 0e0 WHEN {holders} > 1 THEN 0.5e0 "
        f"ELSE [1e0, 0.98e0, 0.98e0, 0.98e0, 0.95e0, 0.9e0][{step}] END AS match_confidence, "
        f"{stu}.i AS matched_student_id, {stu}.r AS matched_roll_number, {stu}.n AS matched_name, "
        f"coalesce({_METHODS}[{step}], 'NONE') AS match_method, "
        f"CASE WHEN {step} = 0 THEN 'UNMATCHED' WHEN {holders} > 1 THEN 'NEEDS_REVIEW' ELSE 'MATCHED' END AS resolution, "
        f"CASE WHEN {step} = 0 THEN 'No matching student found in ERP roster.' WHEN {holders} = 1 THEN NULL "
        f"WHEN {step} = 2 THEN concat('Multiple students share roll number ''', k2, '''') "
        f"WHEN {step} = 3 THEN concat('Multiple students match numeric roll number ''', k3, '''') "
        f"WHEN {step} = 5 THEN 'Multiple students have the exact same name.' ELSE 'Multiple students match this normalized name.' END AS review_reason, "
        f"CASE WHEN {step} = 0 OR {holders} = 1 THEN 0 ELSE {holders} END AS candidates_count FROM {source}"
    )


# the matching-block ratio: the longest common run, then the same left and right of it
PARTS |= {
    "open_names": (("hits",), "SELECT DISTINCT scope_id, k6 AS norm_name FROM hits WHERE step = 0 AND k6 IS NOT NULL"),
    "erp_names": (("roster",), f"SELECT scope_id, {norm('name')} AS erp_name, student_id, roll_number, name, roster_seq FROM roster WHERE {norm('name')} <> ''"),
    "name_pairs": (("open_names", "erp_names"), "SELECT DISTINCT scope_id, norm_name, erp_name FROM open_names JOIN erp_names USING (scope_id)"),
    "text_pairs": (
        ("name_pairs",),
        "SELECT DISTINCT x, y FROM (SELECT DISTINCT norm_name AS x, erp_name AS y FROM name_pairs UNION ALL "
        "SELECT DISTINCT split_part(norm_name, ' ', 1), split_part(erp_name, ' ', 1) FROM name_pairs UNION ALL "
        "SELECT DISTINCT split_part(norm_name, ' ', -1), split_part(erp_name, ' ', -1) FROM name_pairs)",
    ),
    "runs": (
        ("text_pairs",),
        "SELECT x, y, list({'i': i, 'j': j, 'k': k}) AS rs FROM (SELECT x, y, i, j, list_max(list_filter(range(1, least(length(x) - i, length(y) - j) + 1), "
        "lambda n: substr(x, i + 1, n) = substr(y, j + 1, n))) AS k FROM (SELECT x, y, unnest(range(0, length(x))) AS i FROM text_pairs) "
        "JOIN LATERAL (SELECT unnest(range(0, length(y))) AS j) ON true WHERE substr(x, i + 1, 1) = substr(y, j + 1, 1)) GROUP BY x, y",
    ),
    "blocks": (
        ("runs",),
        "SELECT x, y, rs, 0::BIGINT AS alo, length(x)::BIGINT AS ahi, 0::BIGINT AS blo, length(y)::BIGINT AS bhi, {best0} AS best FROM runs "
        "UNION ALL SELECT x, y, rs, w.alo, w.ahi, w.blo, w.bhi, {best1} AS best FROM (SELECT x, y, rs, unnest(["
        "{'alo': alo, 'ahi': -best.i, 'blo': blo, 'bhi': -best.j}, {'alo': best.k - best.i, 'ahi': ahi, 'blo': best.k - best.j, 'bhi': bhi}]) AS w "
        "FROM blocks WHERE best.k > 0) WHERE w.alo < w.ahi AND w.blo < w.bhi",
    ),
    "ratios": (
        ("text_pairs", "blocks"),
        "SELECT t.x, t.y, 2e0 * coalesce(m.m, 0) / (length(t.x) + length(t.y)) AS ratio FROM text_pairs t LEFT JOIN "
        "(SELECT x, y, sum(best.k) AS m FROM blocks GROUP BY x, y) m ON m.x = t.x AND m.y = t.y",
    ),
    "scores": (
        ("name_pairs", "ratios"),
        "SELECT p.scope_id, p.norm_name, p.erp_name, r.ratio AS score FROM name_pairs p JOIN ratios r ON r.x = norm_name AND r.y = erp_name "
        "JOIN ratios f ON f.x = split_part(norm_name, ' ', 1) AND f.y = split_part(erp_name, ' ', 1) "
        "JOIN ratios l ON l.x = split_part(norm_name, ' ', -1) AND l.y = split_part(erp_name, ' ', -1) "
        "WHERE r.ratio >= 0.60 AND (NOT contains(norm_name, ' ') OR NOT contains(erp_name, ' ') OR (f.ratio >= 0.70 AND l.ratio >= 0.60))",
    ),
    "ranked": (
        ("scores", "erp_names"),
        "SELECT s.*, e.student_id, e.roll_number, e.name, row_number() OVER (PARTITION BY s.scope_id, s.norm_name ORDER BY s.score DESC, e.student_id, e.roster_seq) AS rank, "
        "count(*) OVER (PARTITION BY s.scope_id, s.norm_name) AS total FROM scores s JOIN erp_names e USING (scope_id, erp_name)",
    ),
    "decisions": (
        ("ranked",),
        f"SELECT *, CASE WHEN close OR best < 0.88 THEN 'NEEDS_REVIEW' ELSE 'MATCHED' END AS resolution, "
        f"{round2('best * (CASE WHEN close OR best < 0.88 THEN 0.7e0 ELSE 0.9e0 END)')} AS match_confidence, "
        f"CASE WHEN close THEN 'Ambiguous fuzzy match between multiple students.' WHEN best < 0.88 THEN "
        f"concat('Fuzzy match similarity (', {round2('best')}, ') requires teacher review.') END AS review_reason FROM "
        f"(SELECT *, coalesce(best - second < 0.12e0, false) AS close FROM (SELECT scope_id, norm_name, max(least(total, 5)) AS candidates_count, "
        f"max(score) FILTER (WHERE rank = 1) AS best, max(score) FILTER (WHERE rank = 2) AS second, max(student_id) FILTER (WHERE rank = 1) AS student_id, "
        f"max(roll_number) FILTER (WHERE rank = 1) AS roll_number, max(name) FILTER (WHERE rank = 1) AS name FROM ranked GROUP BY scope_id, norm_name))",
    ),
    "exact": (("hits",), _outcome("step", "hits")),
    "resolved": (
        ("exact", "hits", "decisions"),
        "SELECT e.scope_id, e.rec_seq, h.raw_name, h.raw_identifier, e.raw_student_id, h.raw_attendance_mark, e.status, e.ai_confidence, "
        "CASE WHEN d.best IS NULL THEN e.match_confidence ELSE d.match_confidence END AS match_confidence, "
        "coalesce(d.student_id, e.matched_student_id) AS matched_student_id, CASE WHEN d.best IS NULL THEN e.matched_roll_number ELSE d.roll_number END AS matched_roll_number, "
        "coalesce(d.name, e.matched_name) AS matched_name, CASE WHEN d.best IS NULL THEN e.match_method ELSE 'FUZZY_NAME' END AS match_method, "
        "CASE WHEN d.best IS NULL THEN e.resolution ELSE d.resolution END AS resolution, "
        "CASE WHEN d.best IS NULL THEN e.review_reason ELSE d.review_reason END AS review_reason, "
        "CASE WHEN d.best IS NULL THEN e.candidates_count ELSE d.candidates_count END AS candidates_count, "
        "CASE WHEN d.best IS NULL THEN h.step ELSE 7 END AS step, "
        "CASE WHEN d.best IS NOT NULL THEN h.k6 WHEN e.candidates_count = 0 THEN NULL ELSE [k1, k2, k3, k2, k5, k6][h.step] END AS candidate_key "
        "FROM exact e JOIN hits h ON h.scope_id = e.scope_id AND h.rec_seq = e.rec_seq "
        "LEFT JOIN decisions d ON h.step = 0 AND d.scope_id = h.scope_id AND d.norm_name = h.k6",
    ),
    "seen": (
        ("resolved",),
        f"SELECT *, CASE WHEN matched_student_id IS NULL THEN 1 ELSE row_number() OVER w END AS occ, first_value(status) OVER w AS first_status, "
        f"ai_confidence < 0.65 AND resolution = 'MATCHED' AS unclear FROM resolved "
        f"WINDOW w AS (PARTITION BY scope_id, upper({strip('matched_student_id')}) ORDER BY rec_seq)",
    ),
    "results": (
        ("seen",),
        "SELECT * EXCLUDE (resolution, review_reason), occ > 1 AS is_duplicate, occ > 1 AND status <> first_status AS is_conflict, "
        "CASE WHEN unclear OR occ > 1 THEN 'NEEDS_REVIEW' ELSE resolution END AS resolution, "
        "CASE WHEN occ > 1 AND status <> first_status THEN concat('Conflicting attendance records detected for student ID ''', matched_student_id, ''' (', matched_name, '): ', "
        "first_status, ' vs ', status, '. Requires teacher review.') WHEN occ > 1 THEN concat('Duplicate AI record: Student ID ''', matched_student_id, ''' (', matched_name, "
        "') appeared more than once in AI results.') WHEN unclear THEN printf('Unclear physical attendance mark on sheet (AI confidence: %.2f). Requires teacher review.', ai_confidence) "
        "ELSE review_reason END AS review_reason FROM seen",
    ),
    "missing": (
        ("roster", "resolved"),
        f"SELECT * FROM roster r WHERE NOT EXISTS (SELECT 1 FROM resolved x WHERE x.scope_id = r.scope_id AND upper({strip('x.matched_student_id')}) = upper({strip('r.student_id')}))",
    ),
    "exceptions": (
        ("results", "missing"),
        "SELECT scope_id, 0 AS phase, rec_seq AS seq, row_number() OVER (PARTITION BY scope_id, rec_seq ORDER BY o) - 1 AS nth, type, student_id, name, message, "
        "ai_confidence, detected_status, previous_status, current_status, raw_name, raw_identifier, candidates_count FROM ("
        "SELECT scope_id, rec_seq, 1 AS o, 'UNCLEAR_ATTENDANCE_MARK' AS type, matched_student_id AS student_id, coalesce(matched_name, raw_name) AS name, "
        "printf('Unclear physical attendance mark on sheet (AI confidence: %.2f). Requires teacher review.', ai_confidence) AS message, "
        "CAST(ai_confidence AS VARCHAR) AS ai_confidence, status AS detected_status, NULL AS previous_status, NULL AS current_status, NULL AS raw_name, NULL AS raw_identifier, NULL AS candidates_count "
        "FROM results WHERE unclear UNION ALL "
        "SELECT scope_id, rec_seq, 2, 'CONFLICTING_ATTENDANCE_DETECTED', matched_student_id, matched_name, review_reason, NULL, NULL, first_status, status, NULL, NULL, NULL "
        "FROM results WHERE is_conflict UNION ALL "
        "SELECT scope_id, rec_seq, 3, 'DUPLICATE_DETECTED', matched_student_id, matched_name, review_reason, NULL, NULL, NULL, NULL, raw_name, raw_identifier, NULL "
        "FROM results WHERE is_duplicate AND NOT is_conflict UNION ALL "
        "SELECT scope_id, rec_seq, 4, 'AMBIGUOUS_MATCH', matched_student_id, coalesce(matched_name, raw_name), review_reason, NULL, NULL, NULL, NULL, NULL, NULL, CAST(candidates_count AS VARCHAR) "
        "FROM results WHERE resolution = 'NEEDS_REVIEW' AND NOT is_duplicate UNION ALL "
        "SELECT scope_id, rec_seq, 5, 'UNMATCHED_STUDENT', NULL, raw_name, concat('No matching ERP student found for AI record: ''', coalesce(nullif(raw_name, ''), raw_identifier, 'None'), ''''), "
        "NULL, NULL, NULL, NULL, raw_name, raw_identifier, NULL FROM results WHERE resolution = 'UNMATCHED') UNION ALL "
        "SELECT scope_id, 1, roster_seq, 0, 'MISSING_ERP_STUDENT', student_id, name, concat('Student ', student_id, ' (', name, ') was not detected in AI results. Will NOT be marked absent automatically.'), "
        "NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM missing",
    ),
    "summary": (
        ("results", "roster", "missing"),
        "SELECT scope_id, coalesce(a.total, 0) AS total_ai_records, coalesce(a.matched, 0) AS matched, coalesce(a.review, 0) AS needs_review, coalesce(a.un, 0) AS unmatched, "
        "coalesce(a.dup, 0) AS duplicates, coalesce(r.n, 0) AS total_erp_students, coalesce(m.n, 0) AS missing_erp_students_count FROM "
        "(SELECT scope_id, count(*) AS total, count(*) FILTER (WHERE resolution = 'MATCHED') AS matched, count(*) FILTER (WHERE resolution = 'NEEDS_REVIEW') AS review, "
        "count(*) FILTER (WHERE resolution = 'UNMATCHED') AS un, count(*) FILTER (WHERE is_duplicate) AS dup FROM results GROUP BY scope_id) a "
        "FULL JOIN (SELECT scope_id, count(*) AS n FROM roster GROUP BY scope_id) r USING (scope_id) FULL JOIN (SELECT scope_id, count(*) AS n FROM missing GROUP BY scope_id) m USING (scope_id)",
    ),
    "candidates": (
        ("results", "roster", "ranked"),
        f"SELECT scope_id, 2 AS step, upper({strip('roll_number')}) AS key, roster_seq AS position, student_id, roll_number, name, NULL::DOUBLE AS similarity FROM roster UNION ALL "
        f"SELECT scope_id, 3, {unpadded(digits('roll_number'))}, roster_seq, student_id, roll_number, name, NULL FROM roster UNION ALL "
        f"SELECT scope_id, 5, {strip('name')}, roster_seq, student_id, roll_number, name, NULL FROM roster UNION ALL "
        f"SELECT scope_id, 6, {norm('name')}, roster_seq, student_id, roll_number, name, NULL FROM roster UNION ALL "
        f"SELECT scope_id, 7, norm_name, rank, student_id, roll_number, name, {round2('score')} FROM ranked WHERE rank <= 5",
    ),
    "approved": (
        ("results",),
        "SELECT scope_id, rec_seq, CASE WHEN n < 3 THEN matched_student_id WHEN n = 3 THEN 'nobody' END AS student_id, "
        "CASE WHEN n IN (3, 4) THEN coalesce(matched_roll_number, raw_identifier) END AS roll_number, coalesce(matched_name, raw_name) AS name, "
        "CASE WHEN n = 0 THEN lower(status) WHEN rec_seq % 13 = 0 THEN 'LATE' ELSE status END AS status, "
        "CASE WHEN rec_seq % 4 = 0 THEN concat('note ', CAST(rec_seq AS VARCHAR)) ELSE '' END AS remarks FROM (SELECT *, rec_seq % 6 AS n FROM results)",
    ),
    "targets": (
        ("approved", "roster"),
        f"SELECT q.*, coalesce(a.s, b.s, c.s, d.s) AS roster_seq, CASE WHEN upper(q.status) IN ('PRESENT', 'ABSENT') THEN upper(q.status) ELSE 'UNMARKED' END AS final_status, "
        f"CASE WHEN coalesce(a.s, b.s, c.s, d.s) IS NULL THEN 'STUDENT_NOT_FOUND' WHEN coalesce(a.s, b.s, c.s, d.s) % 31 = 7 THEN 'ATTENDANCE_CONTROL_NOT_FOUND' END AS reason FROM approved q "
        f"LEFT JOIN (SELECT scope_id, upper(student_id) AS k, max(roster_seq) AS s FROM roster GROUP BY ALL) a ON a.scope_id = q.scope_id AND a.k = upper({strip('q.student_id')}) AND a.k <> '' "
        f"LEFT JOIN (SELECT scope_id, k, max(roster_seq) AS s FROM (SELECT scope_id, roster_seq, unnest([upper(roll_number), {zero_stripped('upper(roll_number)')}]) AS k FROM roster) WHERE k <> '' GROUP BY ALL) b "
        f"ON b.scope_id = q.scope_id AND b.k = upper({strip('q.roll_number')}) "
        f"LEFT JOIN (SELECT scope_id, k, max(roster_seq) AS s FROM (SELECT scope_id, roster_seq, unnest([upper(roll_number), {zero_stripped('upper(roll_number)')}]) AS k FROM roster) WHERE k <> '' GROUP BY ALL) c "
        f"ON c.scope_id = q.scope_id AND c.k = {zero_stripped('upper(' + strip('q.roll_number') + ')')} "
        f"LEFT JOIN (SELECT scope_id, lower(name) AS k, max(roster_seq) AS s FROM roster GROUP BY ALL) d ON d.scope_id = q.scope_id AND d.k = lower({strip('q.name')}) AND d.k <> ''",
    ),
    "submissions": (
        ("roster", "sessions"),
        "SELECT s.session_id, s.scope_id, s.class_id, s.subject_code, s.submitted_by, s.submitted_at, coalesce(nullif(trim(class_name), ''), 'BCA - 2nd Year (Semester IV)') AS class_name, "
        "coalesce(nullif(trim(subject_name), ''), 'Database Management Systems (CS-401)') AS subject_name, coalesce(section, 'Section A') AS section, session_date, "
        "coalesce(t.n, 0) AS total_students, coalesce(t.p, 0) AS present, coalesce(t.a, 0) AS absent, coalesce(t.l, 0) AS late, coalesce(t.u, 0) AS unmarked, "
        "concat(CAST(day(CAST(session_date AS DATE)) AS VARCHAR), strftime(CAST(session_date AS DATE), ' %b %Y')) AS date_formatted, 'Submitted' AS submit_status, "
        "CASE WHEN coalesce(t.u, 0) > 0 THEN concat('Caution: ', CAST(t.u AS VARCHAR), ' student(s) remain Unmarked. Are you sure you want to proceed?') END AS warning "
        "FROM sessions s LEFT JOIN (SELECT scope_id, count(*) AS n, count(*) FILTER (WHERE status = 'PRESENT') AS p, count(*) FILTER (WHERE status = 'ABSENT') AS a, "
        "count(*) FILTER (WHERE status = 'LATE') AS l, count(*) FILTER (WHERE status NOT IN ('PRESENT', 'ABSENT', 'LATE')) AS u FROM roster GROUP BY scope_id) t USING (scope_id)",
    ),
}


def _best(lo: tuple[str, str, str, str]) -> str:
    alo, ahi, blo, bhi = lo
    return (
        f"coalesce(list_sort(list_transform(list_filter(rs, lambda r: r.i >= {alo} AND r.i < {ahi} AND r.j >= {blo} AND r.j < {bhi}), "
        f"lambda r: {{'k': least(r.k, {ahi} - r.i, {bhi} - r.j), 'i': -r.i, 'j': -r.j}}), 'DESC')[1], {{'k': 0, 'i': 0, 'j': 0}})"
    )


_deps, _sql = PARTS["blocks"]
PARTS["blocks"] = (
    _deps,
    _sql.replace("{best0}", _best(("0", "length(x)", "0", "length(y)"))).replace("{best1}", _best(("w.alo", "w.ahi", "w.blo", "w.bhi"))),
)


def _with(names: tuple[str, ...], select: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in PARTS[name][0]:
                visit(dep)
            if name not in ordered:
                ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return select
    plain = lambda n: f"{n} AS ({PARTS[n][1]})" if n == "blocks" else f"{n} AS MATERIALIZED ({PARTS[n][1]})"
    return f"WITH {'RECURSIVE ' if 'blocks' in ordered else ''}" + ",\n".join(plain(n) for n in ordered) + f"\n{select}"


ORACLES: dict[str, str] = {}


def _oracle(name: str, parts: str, select: str) -> None:
    ORACLES[name] = _with(tuple(parts.split()), select)


_K4 = "l_orderkey, l_partkey, l_suppkey, l_quantity"
_FLAT = (
    "scope_id, rec_seq, raw_student_id, status, ai_confidence, match_confidence, matched_student_id, matched_roll_number, "
    "matched_name, match_method, resolution, review_reason, candidates_count"
)

_KNOWN = "'PRESENT', 'ABSENT', 'LATE', 'UNMARKED'"
PARTS["valid"] = (("made",), f"SELECT * FROM made WHERE ({_reject('coalesce(raw_identifier, ' + chr(39) * 2 + ')')}) IS NULL")

_oracle("f1_normalize_attendance", "marks", f"SELECT event_id, n.status AS status, n.conf AS conf, n.mark AS mark FROM (SELECT event_id, {_marks('mark', 'in_column')} AS n FROM marks)")
_oracle("f2_positive_number", "marks", f"SELECT event_id, regexp_full_match({strip('mark')}, '[0-9]*[1-9][0-9]*') AS is_number FROM marks")
_oracle("f3_strict_status", "marks", f"SELECT event_id, {_strict('mark')} AS status FROM marks")
_oracle("f4_clamp_confidence", "prices", "SELECT o_orderkey, least(greatest(x * 3e0 - 1e0, 0e0), 1e0) AS clamped FROM prices")
_oracle("f5_round2", "prices", f"SELECT o_orderkey, {round2('x')} AS x2, {round2('y')} AS y2 FROM prices")
_oracle("f6_blended_confidence", "prices", f"SELECT o_orderkey, {round2('m')} AS confidence FROM (SELECT o_orderkey, least(greatest(y * 0.75e0 + x * 0.25e0, 0.4e0), 0.99e0) AS m FROM prices)")
_oracle("f7_normalize_name", "records", f"SELECT scope_id, rec_seq, {norm('raw_name')} AS norm_name FROM records")
_oracle("f8_roll_digits", "records", f"SELECT scope_id, rec_seq, {digits('raw_identifier')} AS digits, {unpadded(digits('raw_identifier'))} AS number_key FROM records")
_oracle("f9_accent_key", "", "SELECT conv_id, turn, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS key FROM conversations UNION ALL SELECT -1 - doc_id, 0, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) FROM documents")
_oracle("f10_strip_leading_zeros", "roster", f"SELECT roster_seq, {zero_stripped('roll_number')} AS roll FROM roster")
_oracle("f11_confidence_band", "prices", f"SELECT o_orderkey, CASE WHEN v >= 0.90 THEN 'HIGH' WHEN v >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT o_orderkey, {round2('y')} AS v FROM prices)")
_oracle("f12_repair_roll", "identities", f"SELECT {_K4}, regexp_replace(regexp_replace(roll, '^0[oOuU]([0-9])$', '00\\1'), '^0[oOuU]([0-9]{{2}})$', '0\\1') AS roll FROM identities")
_oracle("f13_split_identity", "identities", f"SELECT {_K4}, roll, sid AS student_id, name FROM ({_split_identity('identities', _K4, 'roll', 'student_id', 'name', '')})")
_oracle("f14_repair_student_id", "identities", f"SELECT {_K4}, {_repair_sid('student_id')} AS student_id FROM identities")
_oracle("f15_repair_name", "identities", f"SELECT {_K4}, {_REPAIR_NAME} AS name FROM identities")
_oracle("f16_page_metadata", "boxes", f"SELECT sheet_id, box_seq, {_is_metadata('text')} AS is_metadata FROM boxes")
_oracle("f17_banner", "boxes", f"SELECT sheet_id, box_seq, {_is_banner('text')} AS is_banner FROM boxes")
_oracle("f18_header_type", "boxes", f"SELECT sheet_id, box_seq, {_header_type('text')} AS col_type FROM boxes")
_oracle("f19_display_date", "sessions", f"SELECT session_id, {_shown_date('session_date')} AS shown FROM sessions UNION ALL SELECT -session_id, {_shown_date(testdata.ODD_DATE)} FROM sessions")
_oracle("f20_name_scores", "scores", "SELECT * FROM scores")
_oracle("f21_status_labels", "roster", f"SELECT roster_seq, CASE WHEN s IN ({_KNOWN}) THEN concat(substr(s, 1, 1), lower(substr(s, 2))) ELSE 'Unmarked' END AS label, CASE WHEN s IN ({_KNOWN}) THEN concat('status-', lower(s)) ELSE 'status-unmarked' END AS badge FROM (SELECT roster_seq, upper({testdata.ANY_STATUS}) AS s FROM roster)")
_oracle("f22_percent", "prices", "SELECT o_orderkey, CAST(floor(y * 100e0 + 0.5e0) AS BIGINT) AS shown FROM prices")

_TYPE = "trim(split_part(lower(coalesce(content_type, '')), ';', 1))"
_TYPE_OK = f"({_TYPE} IN ('', 'image/jpeg', 'image/jpg', 'image/png', 'image/webp') OR regexp_matches(lower(filename), '\\.(jpg|jpeg|png|webp)$'))"
# By the kinds of files that the view makes: a WebP of 12 bytes, a GIF, a text, cut-off files and whole ones.
_FORMAT = "CASE o_kind WHEN 1 THEN 'PNG' WHEN 8 THEN 'PNG' WHEN 2 THEN 'WEBP' WHEN 5 THEN 'WEBP' WHEN 6 THEN 'WEBP' WHEN 3 THEN 'GIF' WHEN 4 THEN NULL ELSE 'JPEG' END"
_CHECKED = (
    f"SELECT sheet_id, image_format, CASE n WHEN 0 THEN NULL WHEN 2 THEN 'FILE_TOO_LARGE' ELSE 'INVALID_IMAGE' END AS error_code, "
    "['Uploaded file is empty.', 'Image is too large. Maximum size is 10MB.', 'Please upload a valid attendance image (JPG, PNG, or WebP).', "
    "'Please upload a valid attendance image.', 'Invalid image file or corrupted data.', concat('Unsupported image format: ', image_format, '. Use JPEG, PNG, or WebP.'), "
    "'Image dimensions are too small to detect attendance.'][n] AS error_message FROM ("
    f"SELECT *, CASE WHEN coalesce(length, 0) = 0 THEN 1 WHEN length > 10485760 THEN 2 WHEN NOT {_TYPE_OK} THEN 3 WHEN o_kind = 4 THEN 4 "
    f"WHEN o_kind IN (2, 7, 8, 9) THEN 5 WHEN o_kind = 3 THEN 6 WHEN width < 50 OR height < 50 THEN 7 ELSE 0 END AS n "
    f"FROM (SELECT *, {_FORMAT} AS image_format FROM (SELECT *, sheet_id % 10 AS o_kind FROM uploads)))"
)
_oracle("s1_upload_validation", "uploads", _CHECKED)
_oracle("s1a_content_type", "uploads", f"SELECT sheet_id, {_TYPE} AS content_type, {_TYPE_OK} AS accepted FROM uploads")
_oracle("s1b_error_details", "uploads", f"SELECT sheet_id, error_code, CAST(CASE error_code WHEN 'INVALID_IMAGE' THEN 400 ELSE 413 END AS INTEGER) AS http_status, CASE error_code WHEN 'INVALID_IMAGE' THEN 'Please upload a valid attendance image.' ELSE 'Image is too large. Maximum size is 10MB.' END AS default_message FROM ({_CHECKED}) WHERE error_code IS NOT NULL")
_oracle("s2_ocr_boxes", "boxes", "SELECT * FROM boxes")
_oracle("s3_roster_intake", "roster", "SELECT scope_id, roster_seq, student_id, roll_number, name, enrollment_number, email, gender, CASE WHEN roster_seq % 2 = 0 THEN status END AS status, CASE WHEN roster_seq % 2 = 0 THEN remarks END AS remarks FROM roster")
_UNTIDY = (
    "SELECT * EXCLUDE (status, confidence), CASE rec_seq % 8 WHEN 0 THEN 'late' WHEN 1 THEN ' 17 ' WHEN 2 THEN 'Status.ABSENT' ELSE status END AS status, "
    "CASE rec_seq % 8 WHEN 3 THEN 0.9e0 WHEN 4 THEN confidence + 0.5e0 ELSE confidence END AS confidence FROM records"
)
_oracle("s4_record_intake", "records", f"SELECT scope_id, rec_seq, raw_name, raw_identifier, raw_student_id, raw_attendance_mark, {_strict('status')} AS status, {round2('confidence')} AS confidence FROM ({_UNTIDY}) WHERE {_strict('status')} IS NOT NULL AND confidence BETWEEN 0 AND 1")
_oracle("p5_record_quarantine", "records", f"SELECT scope_id, rec_seq, status, CASE WHEN {_strict('status')} IS NULL THEN 'status' ELSE 'confidence' END AS quarantine_reason FROM ({_UNTIDY}) WHERE {_strict('status')} IS NULL OR confidence NOT BETWEEN 0 AND 1")
_oracle("s5_page_roster", "roster", "SELECT roster_seq AS page_id, CAST(0 AS INTEGER) AS row_seq, student_id, coalesce(roll_number, '') AS roll_number, name, status, remarks FROM roster")
_oracle("s6_session_metadata", "submissions", "SELECT session_id, scope_id, class_id, subject_code, submitted_by, submitted_at, class_name, subject_name, section, session_date FROM submissions")
_oracle("s6_class_and_subject", "sessions classes subjects", "SELECT session_id, class_id, k.name AS class_label, k.section AS class_section, subject_code, t.name AS subject_label FROM sessions LEFT JOIN classes k ON k.id = class_id LEFT JOIN subjects t ON t.code = subject_code")
_oracle("r4_subject_listing", "subjects", "SELECT code, name, concat(CAST(credits AS VARCHAR), ' Credits') AS credits, type FROM subjects")
_oracle("s8_appended_history", "submissions", "SELECT concat('batch-', CAST(session_id % 3 AS VARCHAR)) AS submission_id, session_id, total_students, present, submitted_by FROM submissions")
_oracle("p1_readable_boxes", "ocr", f"SELECT sheet_id, box_seq, text, conf FROM ocr WHERE conf >= 0.15 AND {strip('text')} <> ''")
_oracle("p2_boxes_in_table", "body", "SELECT sheet_id, box_seq, text FROM body")
_oracle("p3_row_validation", "raw_rows", f"SELECT sheet_id, CAST(row_index AS INTEGER) AS row_index, {_reject('coalesce(raw_identifier, raw_student_id, ' + chr(39) * 2 + ')')} AS reject_reason FROM raw_rows")
_oracle("p4_identified_rows", "made", "SELECT sheet_id, CAST(row_index AS INTEGER) AS row_index FROM made")
_oracle("p6_low_confidence", "good", "SELECT scope_id, rec_seq, confidence FROM good WHERE confidence < 0.65")
_oracle("p7_student_search", "roster", "SELECT scope_id, roster_seq, student_id, name FROM roster WHERE contains(lower(name), 'ring') OR contains(lower(coalesce(roll_number, '')), 'ring') OR contains(lower(student_id), 'ring')")
_oracle("p8_no_attendance", "valid", "SELECT o_orderkey AS sheet_id, 'NO_ATTENDANCE_DETECTED' AS error_code, CAST(422 AS INTEGER) AS http_status, 'No attendance information could be detected.' AS default_message FROM orders WHERE o_orderkey NOT IN (SELECT sheet_id FROM valid)")
_oracle("p9_status_guard", "roster", "SELECT roster_seq, CASE WHEN status IN ('PRESENT', 'ABSENT') THEN status ELSE 'UNMARKED' END AS status FROM roster")

_oracle("g1_header_candidates", "cands", "SELECT sheet_id, box_seq, col_type FROM cands")
_oracle("g2_header_band", "header", "SELECT sheet_id, types, boxes, top, bottom FROM header")
_oracle("g3_body_top", "tops", "SELECT sheet_id, header_min_y, header_max_y, body_top FROM tops")
_oracle("g4_body_bottom", "ends", "SELECT sheet_id, body_bottom FROM ends")
_oracle("g5_body_sides", "sides", "SELECT sheet_id, body_left, body_right FROM sides")
_oracle("g6_g7_g8_columns", "cols", "SELECT sheet_id, col_type, low, high, cx, header_text FROM cols")
_oracle("g9_row_anchors", "anchors", "SELECT * FROM anchors")
_oracle("g10_distinct_anchors", "kept", "SELECT * FROM kept")
_oracle("g11_row_bands", "bands", "SELECT * FROM bands")
_oracle("g12_boxes_to_bands", "in_bands", "SELECT * FROM in_bands")
_oracle("g13_boxes_to_clusters", "in_clusters", "SELECT * FROM in_clusters")
_oracle("g14_boxes_to_cells", "celled", "SELECT sheet_id, box_seq, row_index, cell FROM celled")
_oracle("g15_g16_cell_texts", "texts", "SELECT * FROM texts")
_oracle("g17_records", "made", "SELECT * FROM made")
_oracle("g18_extracted_records", "made", f"SELECT sheet_id, row_index AS rec_seq, * EXCLUDE (sheet_id, row_index) FROM made WHERE ({_reject('coalesce(raw_identifier, ' + chr(39) * 2 + ')')}) IS NULL")

_KEYS_LONG = " UNION ALL ".join(
    f"SELECT scope_id, {i} AS step, k AS match_key, n AS holders, s.i AS last_student_id FROM {t}"
    for i, t in enumerate(("by_id", "by_roll", "by_number", "by_enrol", "by_name", "by_norm"), start=1)
)
_oracle("j0_roster_index", "by_id by_roll by_number by_enrol by_name by_norm", _KEYS_LONG)
for _step, _name in enumerate(
    ("j1_match_student_id", "j2_match_roll", "j3_match_roll_number", "j4_match_enrollment", "j5_match_exact_name", "j6_match_normalized_name"), start=1
):
    _oracle(_name, "hits", _outcome(str(_step), f"(SELECT * FROM hits WHERE h{_step})"))
_oracle("j7_fuzzy_students", "ranked erp_names", "SELECT scope_id, norm_name, roster_seq, student_id, score FROM scores JOIN erp_names USING (scope_id, erp_name)")
_oracle("j8_fuzzy_decisions", "decisions", "SELECT scope_id, norm_name, candidates_count, best, student_id, resolution, match_confidence, review_reason FROM decisions")
_oracle("j9_cascade", "exact", "SELECT * FROM exact")
_oracle("j9_cascade_with_fuzzy", "resolved", f"SELECT {_FLAT} FROM resolved")
_oracle("j10_unmatched", "results", "SELECT scope_id, rec_seq, match_method, match_confidence, review_reason FROM results WHERE resolution = 'UNMATCHED'")
_oracle("j11_raw_student_id", "results", "SELECT scope_id, rec_seq, raw_student_id FROM results")
_oracle("j12_missing_students", "missing", "SELECT scope_id, roster_seq, student_id, name FROM missing")
_oracle("j13_apply_cascade", "targets", "SELECT scope_id, rec_seq, roster_seq, final_status, reason FROM targets")
_oracle(
    "j13_apply_by_id", "approved roster",
    "SELECT q.scope_id, rec_seq, r.s AS roster_seq, upper(q.status) AS final_status, CASE WHEN q.student_id IS NULL THEN 'SKIPPED' WHEN r.s IS NULL THEN 'STUDENT_NOT_FOUND' END AS reason "
    "FROM approved q LEFT JOIN (SELECT scope_id, student_id, max(roster_seq) AS s FROM roster GROUP BY ALL) r ON r.scope_id = q.scope_id AND r.student_id = q.student_id",
)
_oracle(
    "j13_apply_by_id_counting_unknown", "approved roster",
    "SELECT q.scope_id, rec_seq, r.s AS roster_seq, upper(q.status) AS final_status, CASE WHEN q.student_id IS NULL THEN 'SKIPPED' END AS reason "
    "FROM approved q LEFT JOIN (SELECT scope_id, student_id, max(roster_seq) AS s FROM roster GROUP BY ALL) r ON r.scope_id = q.scope_id AND r.student_id = q.student_id",
)
_oracle("j14_missing_controls", "targets", "SELECT scope_id, rec_seq, roster_seq FROM targets WHERE reason = 'ATTENDANCE_CONTROL_NOT_FOUND'")
_oracle("w1_w2_repeats", "results", "SELECT scope_id, rec_seq, is_duplicate, is_conflict, resolution, review_reason FROM results")
_oracle("w3_fuzzy_candidates", "ranked", f"SELECT scope_id, norm_name, rank, student_id, {round2('score')} AS similarity FROM ranked WHERE rank <= 5")
_oracle(
    "j_candidate_lists", "results candidates",
    "SELECT c.scope_id, c.step AS match_step, c.key AS candidate_key, c.position, c.student_id, c.roll_number, c.name, c.similarity FROM candidates c WHERE c.step = 7 OR EXISTS "
    "(SELECT 1 FROM results r WHERE r.scope_id = c.scope_id AND r.step = c.step AND r.candidate_key = c.key)",
)
_oracle(
    "w4_candidate_previews", "results candidates",
    "SELECT r.scope_id, r.rec_seq, string_agg(concat(c.student_id, ' — ', c.name, CASE WHEN c.similarity > 0 THEN concat(' (', CAST(CAST(floor(c.similarity * 100e0 + 0.5e0) AS BIGINT) AS VARCHAR), '%)') ELSE '' END), '; ' ORDER BY c.position) AS preview "
    "FROM results r JOIN (SELECT *, row_number() OVER (PARTITION BY scope_id, step, key ORDER BY position) AS n FROM candidates) c ON c.scope_id = r.scope_id AND c.step = r.step AND c.key = r.candidate_key AND c.n <= 3 "
    "WHERE r.resolution = 'NEEDS_REVIEW' GROUP BY r.scope_id, r.rec_seq",
)
_oracle("w5_missing_in_order", "missing", "SELECT scope_id, coalesce(roll_number, '') AS roll_order, student_id FROM missing ORDER BY 1, 2, 3")
_oracle("w6_results_in_order", "results", "SELECT scope_id, rec_seq, match_method, resolution FROM results ORDER BY 1, 2")
_oracle("a1_attendance_summary", "valid", "SELECT sheet_id, count(*) AS total_detected, count(*) FILTER (WHERE status = 'PRESENT') AS present, count(*) FILTER (WHERE status = 'ABSENT') AS absent FROM valid GROUP BY sheet_id")
_oracle("a2_match_summary", "summary", "SELECT * FROM summary")
_oracle("s7_match_documents", "summary", "SELECT scope_id, CAST(to_json(summary) AS VARCHAR) AS document FROM summary")
_RECORD = "{'raw_name': raw_name, 'raw_identifier': raw_identifier, 'raw_student_id': raw_student_id, 'raw_attendance_mark': raw_attendance_mark, 'status': status, 'confidence': confidence}"
_oracle(
    "s7_extraction_documents", "valid",
    "SELECT sheet_id, CAST(0 AS BIGINT) AS block, concat('{\"success\":true,\"records\":[', string_agg(CAST(to_json(" + _RECORD + ") AS VARCHAR), ',' ORDER BY row_index), '],\"summary\":', "
    "CAST(to_json({'total_detected': count(*), 'present': count(*) FILTER (WHERE status = 'PRESENT'), 'absent': count(*) FILTER (WHERE status = 'ABSENT')}) AS VARCHAR), '}') AS text FROM valid GROUP BY sheet_id",
)
_RESULT = ", ".join(
    f"'{n}': {n}" for n in "raw_identifier raw_student_id raw_name raw_attendance_mark status ai_confidence matched_student_id matched_roll_number "
    "matched_name match_method match_confidence resolution is_duplicate review_reason".split()
)
_DETAIL = ", ".join(
    f"CASE WHEN {k} IS NOT NULL{always} THEN concat('\"{k}\":', coalesce(CAST(to_json({k}) AS VARCHAR), 'null')) END"
    for k, always in [(k, "") for k in ("ai_confidence", "detected_status", "previous_status", "current_status")]
    + [(k, " OR type IN ('DUPLICATE_DETECTED', 'UNMATCHED_STUDENT')") for k in ("raw_name", "raw_identifier")] + [("candidates_count", "")]
)
_oracle(
    "s7_result_documents", "results candidates summary missing exceptions",
    "SELECT scope_id, CAST(0 AS BIGINT) AS block, concat('{\"success\":true,\"results\":[', r.t, '],\"summary\":', CAST(to_json(s) AS VARCHAR), ',\"erp_students_not_detected\":[', m.t, '],\"exceptions\":[', e.t, ']}') AS text "
    "FROM (SELECT scope_id, struct_pack(total_ai_records := total_ai_records, matched := matched, needs_review := needs_review, unmatched := unmatched, duplicates := duplicates, total_erp_students := total_erp_students, missing_erp_students_count := missing_erp_students_count) AS s FROM summary) AS q "
    f"LEFT JOIN (SELECT scope_id, string_agg(concat(regexp_replace(CAST(to_json({{{_RESULT}}}) AS VARCHAR), '\\}}$', ''), ',\"candidates\":[', c.t, ']}}'), ',' ORDER BY rec_seq) AS t FROM results LEFT JOIN "
    "(SELECT scope_id, step, key AS candidate_key, string_agg(CAST(to_json({'student_id': student_id, 'roll_number': roll_number, 'name': name, 'similarity': similarity}) AS VARCHAR), ',' ORDER BY position) AS t FROM candidates GROUP BY ALL) c "
    "USING (scope_id, step, candidate_key) GROUP BY scope_id) r USING (scope_id) "
    "LEFT JOIN (SELECT scope_id, string_agg(CAST(to_json({'student_id': student_id, 'roll_number': roll_number, 'name': name, 'enrollment_number': enrollment_number, 'email': email, 'gender': gender, 'status': status, 'remarks': remarks}) AS VARCHAR), ',' ORDER BY roster_seq) AS t FROM missing GROUP BY scope_id) m USING (scope_id) "
    f"LEFT JOIN (SELECT scope_id, string_agg(concat('{{\"type\":', CAST(to_json(type) AS VARCHAR), ',\"student_id\":', coalesce(CAST(to_json(student_id) AS VARCHAR), 'null'), ',\"name\":', coalesce(CAST(to_json(name) AS VARCHAR), 'null'), ',\"message\":', CAST(to_json(message) AS VARCHAR), ',\"details\":', CASE WHEN type = 'MISSING_ERP_STUDENT' THEN 'null' ELSE concat('{{', concat_ws(',', {_DETAIL}), '}}') END, '}}'), ',' ORDER BY phase, seq, nth) AS t FROM exceptions GROUP BY scope_id) e USING (scope_id)",
)
_oracle("a3_roster_tally", "roster", "SELECT scope_id, count(*) AS total, count(*) FILTER (WHERE status = 'PRESENT') AS present, count(*) FILTER (WHERE status = 'ABSENT') AS absent, count(*) FILTER (WHERE status = 'LATE') AS late, count(*) FILTER (WHERE status NOT IN ('PRESENT', 'ABSENT', 'LATE')) AS unmarked FROM roster GROUP BY scope_id")
_oracle("a4_report_tally", "results exceptions", "SELECT scope_id, count(*) AS records, count(*) FILTER (WHERE status = 'PRESENT') AS present, count(*) FILTER (WHERE status <> 'PRESENT') AS absent, any_value(e.n) AS exceptions FROM results LEFT JOIN (SELECT scope_id, count(*) AS n FROM exceptions GROUP BY scope_id) e USING (scope_id) GROUP BY scope_id")
_oracle("a5_apply_summary", "targets", "SELECT scope_id, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS applied, count(*) FILTER (WHERE reason = 'STUDENT_NOT_FOUND') AS unmatched, count(*) FILTER (WHERE reason = 'ATTENDANCE_CONTROL_NOT_FOUND') AS failed FROM targets GROUP BY scope_id")
_oracle("a6_apply_issues", "sessions roster", "SELECT DISTINCT scope_id * 2 AS scope_id, scope_id * 2 IN (SELECT scope_id FROM roster) AS is_valid, CASE WHEN scope_id * 2 IN (SELECT scope_id FROM roster) THEN '' ELSE 'No student rows found in table.' END AS issues FROM sessions")
_oracle("a7_session_submissions", "submissions", "SELECT * FROM submissions")
_oracle("s8_session_history", "submissions", "SELECT session_id, date_formatted, class_name, present, absent FROM submissions ORDER BY session_date DESC, session_id DESC")
_oracle("e_exceptions", "exceptions", "SELECT * FROM exceptions")
_oracle(
    "r1_review_rows", "results",
    "SELECT scope_id, rec_seq, concat('#', coalesce(nullif(matched_roll_number, ''), nullif(raw_identifier, ''), '-')) AS roll, coalesce(matched_name, raw_name, 'Unknown Student') AS student, "
    "CASE WHEN matched_name <> raw_name AND raw_name <> '' THEN concat('OCR: \"', raw_name, '\"') WHEN matched_student_id IS NOT NULL THEN concat('#', matched_student_id) WHEN raw_student_id <> '' THEN concat('#', raw_student_id) ELSE '' END AS sub_line, "
    "coalesce(nullif(raw_attendance_mark, ''), substr(status, 1, 1)) AS mark, status AS status_label, CASE resolution WHEN 'MATCHED' THEN 'MATCH' WHEN 'NEEDS_REVIEW' THEN 'REVIEW' ELSE 'UNMATCH' END AS match_label, "
    "CAST(floor(ai_confidence * 100e0 + 0.5e0) AS BIGINT) AS ai_percent, CAST(floor(match_confidence * 100e0 + 0.5e0) AS BIGINT) AS match_percent FROM results",
)
_oracle("r2_exception_rows", "exceptions", "SELECT scope_id, seq, CASE type WHEN 'DUPLICATE_DETECTED' THEN 'Duplicate' WHEN 'AMBIGUOUS_MATCH' THEN 'Needs Review' WHEN 'MISSING_ERP_STUDENT' THEN 'Not Detected' ELSE 'Unmatched' END AS label FROM exceptions")
_oracle(
    "r3_sheet_only_rows", "good",
    "SELECT scope_id, rec_seq, concat('#', coalesce(nullif(raw_identifier, ''), '-')) AS roll, coalesce(nullif(raw_name, ''), 'Unknown') AS student, CASE WHEN raw_student_id <> '' THEN concat('#', raw_student_id) ELSE '' END AS sub_line, "
    "coalesce(nullif(raw_attendance_mark, ''), substr(status, 1, 1)) AS mark, status AS status_label, CAST(floor(confidence * 100e0 + 0.5e0) AS BIGINT) AS confidence_percent FROM good WHERE scope_id % 3 = 1",
)
_oracle("r4_roster_listing", "roster", "SELECT scope_id, roster_seq, roll_number, student_id, name, gender, email, 'Enrolled / Active' AS enrolment FROM roster WHERE contains(lower(concat(name, '|', roll_number, '|', student_id)), 'bolt')")
_oracle(
    "m1_apply_statuses", "targets roster",
    "SELECT r.scope_id, r.roster_seq, r.student_id, coalesce(c.s, r.status) AS status, coalesce(c.m, r.remarks) AS remarks, c.s IS NOT NULL AS modified FROM roster r LEFT JOIN "
    "(SELECT scope_id, roster_seq, arg_max(final_status, rec_seq) AS s, arg_max(remarks, rec_seq) FILTER (WHERE remarks <> '') AS m FROM targets WHERE reason IS NULL GROUP BY ALL) c USING (scope_id, roster_seq)",
)
_oracle(
    "m1_roster_versions", "targets roster",
    "SELECT 1 AS version, scope_id, roster_seq, status, remarks, false AS modified FROM roster UNION ALL "
    "SELECT 2, r.scope_id, r.roster_seq, coalesce(c.s, r.status), coalesce(c.m, r.remarks), c.s IS NOT NULL FROM roster r LEFT JOIN "
    "(SELECT scope_id, roster_seq, arg_max(final_status, rec_seq) AS s, arg_max(remarks, rec_seq) FILTER (WHERE remarks <> '') AS m FROM targets "
    "WHERE reason IS NULL AND scope_id % 4 = 1 GROUP BY ALL) c USING (scope_id, roster_seq)",
)
_oracle(
    "m2_change_statuses", "approved roster",
    "SELECT r.scope_id, r.roster_seq, coalesce(c.s, r.status) AS status, c.s IS NOT NULL AS modified FROM roster r LEFT JOIN (SELECT scope_id, student_id, "
    "arg_max(CASE WHEN status IN ('PRESENT', 'ABSENT', 'LATE', 'UNMARKED') THEN status ELSE 'UNMARKED' END, rec_seq) AS s FROM approved GROUP BY ALL) c ON c.scope_id = r.scope_id AND c.student_id = r.student_id",
)
_oracle("m3_bulk_statuses", "roster", "SELECT roster_seq, CASE WHEN scope_id % 2 = 0 THEN 'PRESENT' ELSE status END AS status, scope_id % 2 = 0 AS modified FROM roster")
_oracle("m4_session_rows", "roster", "SELECT scope_id, min(roster_seq) AS roster_seq, student_id, arg_max(coalesce(roll_number, '~'), roster_seq) AS roll_number, arg_max(name, roster_seq) AS name, 'UNMARKED' AS status, '' AS remarks, false AS modified FROM roster GROUP BY scope_id, student_id")
ORACLES["m4_session_rows"] = ORACLES["m4_session_rows"].replace(
    "arg_max(coalesce(roll_number, '~'), roster_seq) AS roll_number", "nullif(arg_max(coalesce(roll_number, '~'), roster_seq), '~') AS roll_number"
)
