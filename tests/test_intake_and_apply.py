import struct
import zlib

from rollkeeper.operators import apply
from rollkeeper.sources import pages, uploads


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\x00" + b"\xff\xff\xff" * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_upload_files(spark, tmp_path):
    files = {
        "good.png": (png(80, 60), "image/png"), "small.png": (png(40, 40), "image/png"), "empty.png": (b"", "image/png"),
        "text.png": (b"plain text, no picture", "image/png"), "big.png": (b"\x89PNG" + b"0" * (11 * 1024 * 1024), "image/png"),
        "type.bin": (png(80, 60), "text/plain"), "ending.png": (png(80, 60), "text/plain"),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame(
        [(i, f"file://{tmp_path}/{n}", n, kind) for i, (n, (_, kind)) in enumerate(files.items())],
        "sheet_id long, path string, filename string, content_type string")
    checked = uploads.validate_uploads(uploads.read_uploads(spark, manifest, str(tmp_path)))
    got = {r.filename: r.error_code for r in checked.collect()}
    bad = "INVALID_IMAGE"
    assert got == {"good.png": None, "small.png": bad, "empty.png": bad, "text.png": bad, "big.png": "FILE_TOO_LARGE", "type.bin": bad, "ending.png": None}
    none = uploads.sheets_without_records(checked, spark.createDataFrame([(6,)], "sheet_id long"))
    assert [(r.sheet_id, r.http_status) for r in uploads.with_error_details(none).collect()] == [(0, 422)]


def test_page_rows_fall_back_to_cells(spark):
    html = (
        '<table><tr data-student-row="true" data-student-id="X"><td></td></tr></table><table id="attendance-table"><tbody>'
        '<tr data-student-row="true" data-student-id="S1" data-roll-number="001" data-student-name="A &amp; B" data-attendance-state="late"><td></td></tr>'
        '<tr data-student-row="true" id="row-S2"><td data-field="roll-number"> 002 </td><td data-field="student-name">Cy</td>'
        '<td><select class="attendance-select"><option value="UNMARKED">-</option><option value="absent" selected>A</option></select></td></tr>'
        "<tr><td>no student</td></tr></tbody></table>"
    )
    got = pages.roster_from_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [tuple(r)[2:] for r in got] == [("S1", "001", "A & B", "LATE", ""), ("S2", "002", "Cy", "ABSENT", "")]


def test_apply_order_and_last_record_wins(spark):
    rows = spark.createDataFrame(
        [(1, 0, "S1", "001", "Ann", "UNMARKED", "", False), (1, 1, "S2", "2", "Bob", "UNMARKED", "x", False), (1, 2, "S3", "3", "Cy", "UNMARKED", "", True)],
        "scope_id long, roster_seq long, student_id string, roll_number string, name string, status string, remarks string, locked boolean")
    approved = spark.createDataFrame(
        [(1, 0, " s1 ", None, None, "present", ""), (1, 1, "none", "1", None, "LATE", "seen"), (1, 2, None, "002", "Ann", "ABSENT", ""),
         (1, 3, None, None, "CY", "PRESENT", ""), (1, 4, None, "77", "Nobody", "PRESENT", "")],
        "scope_id long, rec_seq long, student_id string, roll_number string, name string, status string, remarks string")
    targets = apply.apply_targets(rows, approved)
    got = [(r.roster_seq, r.final_status, r.reason) for r in targets.orderBy("rec_seq").collect()]
    assert got == [(0, "PRESENT", None), (0, "UNMARKED", None), (1, "ABSENT", None), (2, "PRESENT", apply.NO_CONTROL), (None, "PRESENT", apply.NOT_FOUND)]
    assert tuple(apply.apply_summary(targets).first()) == (1, 5, 3, 1, 1)
    new = apply.updated_rows(rows, targets).orderBy("roster_seq").select("status", "remarks", "modified").collect()
    assert [tuple(r) for r in new] == [("UNMARKED", "seen", True), ("ABSENT", "x", True), ("UNMARKED", "", False)]


def jpeg(width, height, extra=b"", scan=b"\x12\xff\x00\x34", end=b"\xff\xd9"):
    app = b"\xff\xe1" + struct.pack(">H", 2 + 6) + b"\xff\xd9\xff\xd8\xff\xc0"
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9)
    table = b"\xff\xc4" + struct.pack(">H", 4) + b"\xff\xd9"
    return b"\xff\xd8" + app + extra + frame + table + b"\xff\xda" + struct.pack(">H", 3) + b"\x00" + scan + end


def plain_png_is_whole(data):
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IEND":
            return data[12:16] == b"IHDR"
        at += 12 + n
        if at > len(data):
            return False
    return False


def test_pictures_are_walked_to_their_end(spark):
    good = png(80, 60)
    many = good[:33] + b"".join(struct.pack(">I4s", 1, b"tEXt") + b"xabcd" for _ in range(3000)) + good[33:]
    webp = b"RIFF" + struct.pack("<I", 22) + b"WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (79).to_bytes(3, "little") + (59).to_bytes(3, "little")
    cases = {
        "jpeg": (jpeg(80, 60), ("JPEG", 80, 60, True)),
        "appended clip": (jpeg(80, 60) + bytes(50_000) + b"ftypmp4", ("JPEG", 80, 60, True)),
        "fill bytes": (jpeg(80, 60, b"\xff\xff\xff" + b"\xff\xe0\x00\x04ab" + b"\xff" * 500), ("JPEG", 80, 60, True)),
        "many segments": (jpeg(80, 60, b"\xff\xfe\x00\x03x" * 2000), ("JPEG", 80, 60, True)),
        "no end mark": (jpeg(80, 60, end=b""), ("JPEG", 80, 60, False)),
        "end mark cut": (jpeg(80, 60)[:-1], ("JPEG", 80, 60, False)),
        "cut in the frame": (jpeg(80, 60)[:20], ("JPEG", None, None, False)),
        "cut in a segment": (jpeg(80, 60)[:8], ("JPEG", None, None, False)),
        "no frame": (b"\xff\xd8\xff\xd9", ("JPEG", None, None, False)),
        "no mark": (b"\xff\xd8ab" + jpeg(8, 8), ("JPEG", None, None, False)),
        "png": (good, ("PNG", 80, 60, True)),
        "png and more": (good + b"trailing" * 1000, ("PNG", 80, 60, True)),
        "many chunks": (many, ("PNG", 80, 60, True)),
        "many chunks cut": (many[:-12], ("PNG", 80, 60, False)),
        "png cut": (good[:-12], ("PNG", 80, 60, False)),
        "png chunk cut": (good[:50], ("PNG", 80, 60, False)),
        "webp": (webp, ("WEBP", 80, 60, True)),
        "webp cut": (webp[:-1], ("WEBP", 80, None, False)),
        "webp kind": (webp.replace(b"VP8X", b"VP8Y"), ("WEBP", None, None, False)),
        "gif": (b"GIF89a" + struct.pack("<HH", 80, 60) + b"\x80\x00\x00;", ("GIF", 80, 60, True)),
        "bmp": (b"BM" + struct.pack("<I", 26) + bytes(12) + struct.pack("<ii", 80, -60), ("BMP", 80, 60, True)),
        "text": (b"plain text", (None, None, None, False)),
        "empty": (b"", (None, None, None, False)),
        "mark alone": (b"\xff\xd8", ("JPEG", None, None, False)),
    }
    assert all(plain_png_is_whole(d) == want[3] for d, want in cases.values() if want[0] == "PNG")
    table = spark.createDataFrame([(k, bytearray(d)) for k, (d, _) in cases.items()], "name string, content binary")
    found = table.select("name", uploads.read_picture(table["content"]).alias("p"))
    assert {r.name: tuple(r.p) for r in found.collect()} == {k: want for k, (_, want) in cases.items()}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_files_are_walked_in_linear_time(spark):
    import time

    slow = [b"\xff\xd8" + b"\xff" * 20_000, jpeg(80, 60, b"\xff\xfe\x00\x02" * 10_000), png(8, 8)[:33] + (struct.pack(">I4s", 0, b"tEXt") + b"abcd") * 10_000]
    began = time.time()
    rows = spark.createDataFrame([(bytearray(d),) for d in slow], "content binary")
    assert [r.p.whole for r in rows.select(uploads.read_picture(rows["content"]).alias("p")).collect()] == [False, True, False]
    assert time.time() - began < 60
