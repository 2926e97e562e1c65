"""Headline queries at one scale; prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from rollkeeper.plans import registry  # noqa: E402

HEADLINE = [
    "f1_normalize_attendance",
    "s5_page_roster",
    "j9_cascade",
    "j8_fuzzy_decisions",
    "j9_cascade_with_fuzzy",
    "w1_w2_repeats",
    "e_exceptions",
    "a2_match_summary",
    "s2_ocr_boxes",
    "g2_header_band",
    "g18_extracted_records",
    "j13_apply_cascade",
    "m1_apply_statuses",
    "a7_session_submissions",
    "r1_review_rows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rollkeeper-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_STAGES") or tempfile.mkdtemp(prefix="rollkeeper-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["a3_roster_tally"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up
    seconds, warm = {}, {}
    for name in HEADLINE:
        # Cold: the query makes its own stages; warm: it finds those it has just made.
        registry.forget_stored()
        for taken in (seconds, warm):
            began = time.time()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.time() - began, 2)
        print(name, seconds[name], warm[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "queries": seconds,
                "warm": warm,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
