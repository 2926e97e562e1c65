import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from rollkeeper.functions import marks, numeric, repair, text
from rollkeeper.functions.headers import header_type, is_page_metadata


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def results(df, expression):
    return [r[0] for r in df.select(expression.alias("y")).collect()]


def test_round2_equals_python_round(spark):
    rng = random.Random(5)
    values = [i / 2000 for i in range(2001)] + [rng.random() for _ in range(20000)]
    values += [0.575, 0.975, 0.285, 1.005, 0.6875]
    assert results(column(spark, values, "double"), numeric.round2(F.col("x"))) == [round(v, 2) for v in values]


def test_marks(spark):
    expected = {
        "1": ("PRESENT", 0.97, "1"), "17A": ("ABSENT", 0.96, "17A"), "P1": ("PRESENT", 0.96, "P1"),
        "00": ("ABSENT", 0.95, "0"), "#17": ("PRESENT", 0.95, "17"), "17.": ("PRESENT", 0.95, "17"),
        "--": ("ABSENT", 0.45, "--"), "N/A": ("ABSENT", 0.45, "N/A"), "i": ("PRESENT", 0.60, "i"),
        "O": ("ABSENT", 0.55, "O"), " ✓ ": ("PRESENT", 0.98, "✓"), "-": ("ABSENT", 0.98, "-"), "0": ("ABSENT", 0.98, "0"),
        "LATE": ("ABSENT", 0.45, "LATE"), "\t": ("ABSENT", 0.40, ""), None: ("ABSENT", 0.40, ""),
        "9" * 40: ("PRESENT", 0.97, "9" * 40),
    }
    out = marks.with_mark_outcome(column(spark, list(expected)), "x").collect()
    assert {r.x: tuple(r.norm) for r in out} == expected
    outside = marks.with_mark_outcome(column(spark, ["17"]), "x", False).first()
    assert tuple(outside.norm) == ("ABSENT", 0.45, "17")


def test_strict_status(spark):
    good = {"P": "PRESENT", " present ": "PRESENT", "✓": "PRESENT", "12": "PRESENT", "Status.ABSENT": "ABSENT", "0": "ABSENT"}
    bad = ["LATE", "UNKNOWN", "MAYBE_PRESENT", "", None, "00"]
    assert results(column(spark, list(good) + bad), marks.strict_status(F.col("x"))) == list(good.values()) + [None] * len(bad)


def test_names_and_rolls(spark):
    assert results(column(spark, ["  José  O'Neil-Roy. ", None, "अमित_1"]), text.normalize_name(F.col("x")))[:2] == ["josé o neil roy", ""]
    assert results(column(spark, ["Roll 015", "#02", "STU001", "a1 20 30", None]), text.roll_digits(F.col("x"))) == ["015", "02", None, "20", None]
    assert results(column(spark, ["000", "Roll 0012"]), text.roll_number_key(F.col("x"))) == ["0", "12"]
    assert results(column(spark, ["  ÉLAN  Müller "]), text.fold_accents(F.col("x"))) == ["elan muller"]
    same = spark.createDataFrame([("José", "JOSE"), ("Ann", "Anne")], "a string, b string")
    assert results(same, text.same_name_ignoring_accents(F.col("a"), F.col("b"))) == [True, False]


def test_identity_repairs(spark):
    rows = [
        ("0u4", None, "Rahul", "004", None, "Rahul"),
        ("0O12", "STUOO1", "A $.", "012", "STU001", "A S."),
        ("001 stu001", "X1", None, "001", "STU001", None),
        ("007", None, "stu007 | Priya -", "007", "STU007", "Priya"),
        ("BCA123", None, "Ann", "BCA123", "BCA123", "Ann"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "roll string, sid string, name string")
    df = repair.with_split_identity(df.withColumn("roll", repair.repair_roll(F.col("roll"))), "roll", "sid", "name")
    out = df.select("roll", repair.repair_student_id(F.col("sid")), repair.repair_name(F.col("name"))).collect()
    assert [tuple(r) for r in out] == [r[3:] for r in rows]


def test_headers(spark):
    texts = {"Reg No.": "ROLL_NO", "Student 017": "NAME", "Enrollment No": "STUDENT_ID", "Att": "ATTENDANCE", "Xyz": None, "my id": "STUDENT_ID"}
    assert results(column(spark, list(texts)), header_type(F.col("x"))) == list(texts.values())
    pages = {"Page No.": True, "Page No. 12": False, "Date: 1": True, "12/3/24": True, "Semira": True, "Aarav": False}
    assert results(column(spark, list(pages)), is_page_metadata(F.col("x"))) == list(pages.values())


def test_library_score_is_asymmetric_so_argument_order_counts():
    assert SequenceMatcher(None, "tide", "diet").ratio() != SequenceMatcher(None, "diet", "tide").ratio()


def test_blanks_are_those_of_the_pattern(spark):
    df = column(spark, [chr(code) for code in range(1, 0x3100)])
    found = df.filter(F.col("x").rlike(rf"(?U)^[{text.BLANK}]$")).collect()
    assert sorted(r.x for r in found) == sorted(text.BLANKS)
