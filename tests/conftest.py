import pytest
from pyspark.sql import SparkSession

from rollkeeper.session import configure

ROSTER = (
    "scope_id long, roster_seq long, student_id string, roll_number string, name string, enrollment_number string, "
    "email string, gender string, status string, remarks string"
)
RECORDS = (
    "scope_id long, rec_seq long, raw_name string, raw_identifier string, raw_student_id string, "
    "raw_attendance_mark string, status string, confidence double"
)
BOXES = (
    "sheet_id long, box_seq long, text string, conf double, min_x double, max_x double, min_y double, max_y double, "
    "cx double, cy double, w double, h double, img_w double, img_h double"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("rollkeeper-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture(scope="session")
def make(spark):
    """Builders of small input tables."""

    class Make:
        @staticmethod
        def roster(students, scope=1):
            rows = [
                (scope, i, sid, roll, name, enrol, None, None, None, None)
                for i, (sid, roll, name, enrol) in enumerate(students)
            ]
            return spark.createDataFrame(rows, ROSTER)

        @staticmethod
        def records(items, scope=1):
            """Items are ``(identifier, name, student_id, status, confidence)``."""
            rows = [(scope, i, name, ident, sid, None, status, conf) for i, (ident, name, sid, status, conf) in enumerate(items)]
            return spark.createDataFrame(rows, RECORDS)

        @staticmethod
        def boxes(items, width=800.0, height=300.0, sheet=1):
            """Items are ``(text, conf, cx, cy, w, h)``."""
            rows = [
                (sheet, i, t, conf, x - w / 2, x + w / 2, y - h / 2, y + h / 2, float(x), float(y), float(w), float(h), width, height)
                for i, (t, conf, x, y, w, h) in enumerate(items)
            ]
            return spark.createDataFrame(rows, BOXES)

    return Make


SIXTY = [("Aarav", "Sharma"), ("Aarav", "Verma"), ("Rahul", "Kumar"), ("Rahul", "Singh"), ("Priya", "Singh"),
         ("Priya", "Sharma"), ("Ankit", "Kumar"), ("Ankit", "Sharma"), ("Sneha", "Patel"), ("Neha", "Gupta")]


@pytest.fixture(scope="session")
def class_of_sixty(make):
    names = [" ".join(n) for n in SIXTY] + [f"Student {i:03d}" for i in range(len(SIXTY) + 1, 61)]
    return make.roster([(f"STU{i:03d}", f"{i:03d}", n, f"EN{i}") for i, n in enumerate(names, start=1)])
