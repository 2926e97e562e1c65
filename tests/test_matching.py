import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from rollkeeper.config import MatchConfig
from rollkeeper.functions.similarity import name_score
from rollkeeper.operators import fuzzy
from rollkeeper.plans.reconcile import reconcile
from rollkeeper.plans.sinks import write_match

C = MatchConfig()


def outcome(records, roster):
    out = reconcile(records, roster)
    return out, [r.asDict() for r in out.results.orderBy("scope_id", "rec_seq").collect()]


def test_each_step(make, class_of_sixty):
    records = make.records(
        [
            ("STU001", "Aarav Sharma", None, "PRESENT", 0.98),
            ("Roll 002", None, None, "PRESENT", 0.95),
            (None, "Priya Singh", None, "ABSENT", 0.94),
            (None, "Rahul Kumr", None, "PRESENT", 0.90),
            (None, "Suresh Patel", None, "PRESENT", 0.90),
            ("en7", None, None, "PRESENT", 0.9),
            (None, "  ANKIT   sharma. ", None, "PRESENT", 0.9),
            ("STU009", None, "STU999", "ABSENT", 0.9),
            ("STU010", "Wrong Name", None, "ABSENT", 0.45),
        ]
    )
    out, rows = outcome(records, class_of_sixty)
    got = [(r["match_method"], r["resolution"], r["matched_student_id"], r["match_confidence"]) for r in rows]
    assert got == [
        ("STUDENT_ID", "MATCHED", "STU001", 1.0),
        ("ROLL_NUMBER", "MATCHED", "STU002", 0.98),
        ("EXACT_NAME", "MATCHED", "STU005", 0.95),
        ("FUZZY_NAME", "MATCHED", "STU003", 0.86),
        ("NONE", "UNMATCHED", None, 0.0),
        ("ENROLLMENT_NUMBER", "MATCHED", "STU007", 0.98),
        ("NORMALIZED_NAME", "MATCHED", "STU008", 0.9),
        ("NONE", "UNMATCHED", None, 0.0),
        ("STUDENT_ID", "NEEDS_REVIEW", "STU010", 1.0),
    ]
    assert rows[8]["status"] == "ABSENT"
    kinds = [r.type for r in out.exceptions.filter("phase = 0 and seq = 8").orderBy("nth").collect()]
    assert kinds == ["UNCLEAR_ATTENDANCE_MARK", "AMBIGUOUS_MATCH"]


def test_shared_name_and_short_name(make):
    roster = make.roster([("STU021", "021", "Rahul Kumar", None), ("STU043", "043", "Rahul Kumar", None)])
    out, rows = outcome(make.records([(None, "Rahul Kumar", None, "PRESENT", 0.9), (None, "Rahul", None, "PRESENT", 0.9)]), roster)
    assert [(r["match_method"], r["resolution"], r["candidates_count"], r["match_confidence"]) for r in rows] == [
        ("EXACT_NAME", "NEEDS_REVIEW", 2, 0.5),
        ("FUZZY_NAME", "NEEDS_REVIEW", 2, 0.44),
    ]
    assert rows[0]["matched_student_id"] is None and rows[1]["matched_student_id"] == "STU021"
    listed = out.candidates.orderBy("match_step", "position").select("match_step", "student_id").collect()
    assert [tuple(r) for r in listed] == [(5, "STU021"), (5, "STU043"), (7, "STU021"), (7, "STU043")]


def test_repeat_conflict_missing_and_summary(make, class_of_sixty):
    items = [(f"STU{i:03d}", None, None, "PRESENT", 0.9) for i in range(1, 59)]
    items += [("STU001", None, None, "PRESENT", 0.9), ("STU002", None, None, "ABSENT", 0.9)]
    out, rows = outcome(make.records(items), class_of_sixty)
    assert [(r["is_duplicate"], r["is_conflict"], r["resolution"]) for r in rows[-2:]] == [
        (True, False, "NEEDS_REVIEW"), (True, True, "NEEDS_REVIEW")]
    assert [r["is_duplicate"] for r in rows[:2]] == [False, False]
    assert [r.student_id for r in out.missing.orderBy("roll_order", "student_id").collect()] == ["STU059", "STU060"]
    assert tuple(out.summary.first())[1:] == (60, 58, 2, 0, 2, 60, 2)


def test_one_sided_scopes_and_last_row_wins(make):
    roster = make.roster([("S1", "1", "Old", None), ("S1", "2", "New", None)], scope=1)
    roster = roster.unionAll(make.roster([("S9", None, "Alone", None)], scope=2))
    records = make.records([("s1", None, None, "PRESENT", 0.9)], scope=1).unionAll(
        make.records([("s1", None, None, "PRESENT", 0.9)], scope=3))
    out, rows = outcome(records, roster)
    assert [(r["scope_id"], r["matched_name"]) for r in rows] == [(1, "New"), (3, None)]
    summary = {r.scope_id: tuple(r)[1:] for r in out.summary.collect()}
    assert summary == {1: (1, 1, 0, 0, 0, 2, 0), 2: (0, 0, 0, 0, 0, 1, 1), 3: (1, 0, 0, 1, 0, 0, 0)}


def random_names(rng, n):
    pools = (["rahul", "rahol", "raul", "priya", "priyanka", "anna", "ana", "sneha", "neha"], ["kumar", "kumr", "kumari", "patel", "patil", "s", "singh"])
    made = set()
    while len(made) < n:
        words = [rng.choice(pools[0])] + ([rng.choice(pools[1])] if rng.random() < 0.8 else [])
        if rng.random() < 0.3:
            words.insert(1, rng.choice("abc"))
        if rng.random() < 0.5:
            w = list(words[-1])
            w[rng.randrange(len(w))] = rng.choice("aeiourst")
            words[-1] = "".join(w)
        made.add(" ".join(words))
    return sorted(made)


def test_blocks_lose_no_pair(spark):
    rng = random.Random(11)
    left, right = random_names(rng, 150), random_names(rng, 150)
    # Long words, repeated letters, single words, and names of more than two words.
    odd = ["anna", "aaaa bbbb", "aaab bbbb", "mississippi missouri", "misisipi misouri", "x" * 60 + " kumar", "x" * 58 + " kumar", "maria del carmen lopez", "maria carmen lopes"]
    left, right = sorted({*left, *odd}), sorted({*right, *odd})
    names = spark.createDataFrame([(1, n) for n in left], "scope_id long, norm_name string")
    rows = [(1, i, f"S{i}", None, n) for i, n in enumerate(right)]
    roster = spark.createDataFrame(rows, "scope_id long, roster_seq long, student_id string, roll_number string, name string")
    got = {(r.norm_name, r.erp_name): r.score for r in fuzzy.scored_pairs(names, roster).collect()}

    def brute(a, b):
        ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
        aw, bw = a.split(), b.split()
        apart = min(len(aw), len(bw)) > 1 and (ratio(aw[0], bw[0]) < 0.7 or ratio(aw[-1], bw[-1]) < 0.6)
        return 0.0 if apart else ratio(a, b)

    expected = {(a, b): brute(a, b) for a in left for b in right if brute(a, b) >= 0.6}
    assert got == expected and len(expected) > 500
    assert all(name_score(a, b) == s for (a, b), s in expected.items())


def test_blocks_grow_with_the_letters_of_a_name(spark):
    letters = random.Random(5)
    sizes = [10, 40, 160, 400]
    names = [" ".join("".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for _ in range(2)) for n in sizes]
    table = spark.createDataFrame([(1, n) for n in names], "scope_id long, norm_name string")
    words = fuzzy.spelled_words(fuzzy.name_words(table, "norm_name", True))
    got = {(r.kind, r.word): len(r["keys"]) for r in words.collect()}
    assert all(got["first", n.split()[0]] + got["last", n.split()[1]] <= len(n) for n in names)
    assert all(n <= len(w) for (_, w), n in got.items())


def test_words_are_scored_once_for_all_classes(spark):
    """The same words in many classes are as many rows for the score as in one."""
    names = [(s, n) for s in range(20) for n in ("rahul kumr", "rahol kumar", "ana patil")]
    students = [(s, n) for s in range(20) for n in ("rahul kumar", "raul kumari", "anna patel", "rahul")]
    probes = spark.createDataFrame(names, "scope_id long, norm_name string")
    roster = spark.createDataFrame(students, "scope_id long, erp_name string")
    similar = fuzzy.similar_words(fuzzy.name_words(probes, "norm_name", True), fuzzy.name_words(roster, "erp_name", False))
    rows = similar.collect()
    assert len(rows) == 20 * len({(r.kind, r.a, r.b) for r in rows})
    text = similar._jdf.queryExecution().executedPlan().toString()
    # The score runs on an aggregate of word pairs without their scope.
    assert "keys=[kind#" in text and text.index("ArrowEvalPython") < text.index("HashAggregate")


def test_lazy_plan_equals_stored(spark):
    rng = random.Random(3)
    names = spark.createDataFrame([(i % 3, n) for i, n in enumerate(random_names(rng, 40))], "scope_id long, norm_name string")
    rows = [(i % 3, i, f"S{i}", None, n) for i, n in enumerate(random_names(rng, 40))]
    roster = spark.createDataFrame(rows, "scope_id long, roster_seq long, student_id string, roll_number string, name string")
    sides = [sorted(map(tuple, fuzzy.scored_pairs(names, roster, keep=k).collect())) for k in (fuzzy.stage, lambda df: df)]
    assert sides[0] == sides[1] and sides[0]


def test_hot_scope_and_order_do_not_change_results(spark, make):
    """A third of all rows in one scope, most of them one student; input order shuffled."""
    roster = make.roster([(f"S{i}", f"{i}", f"Name {i % 40}", None) for i in range(300)], scope=1)
    items = [("S1" if i % 3 else f"S{i % 300}", None, None, "PRESENT" if i % 7 else "ABSENT", 0.9) for i in range(2000)]
    records = make.records(items, scope=1)
    for scope in range(2, 12):
        roster = roster.unionAll(make.roster([("S1", "1", "Solo", None)], scope=scope))
        records = records.unionAll(make.records([("S1", None, None, "PRESENT", 0.9)] * 5, scope=scope))
    _, rows = outcome(records, roster)
    first = {}
    for i, (sid, *_rest) in enumerate(items):
        first.setdefault(sid, (i, items[i][3]))
    for r in rows[: len(items)]:
        seq, status = first[r["matched_student_id"]]
        assert r["is_duplicate"] == (r["rec_seq"] > seq)
        assert r["is_conflict"] == (r["rec_seq"] > seq and r["status"] != status)
    _, again = outcome(records.orderBy(F.rand(3)).repartition(7), roster.orderBy(F.rand(4)).repartition(3))
    assert again == rows


def test_written_match_equals_direct(make, class_of_sixty, tmp_path):
    records = make.records([("STU001", None, None, "PRESENT", 0.9), (None, "Rahul Kumr", None, "ABSENT", 0.5), (None, "Zed", None, "ABSENT", 0.9)])
    stored = write_match(records, class_of_sixty, str(tmp_path / "match"))
    direct = reconcile(records, class_of_sixty)
    for part in ("results", "candidates", "missing", "exceptions", "summary"):
        side = [sorted(map(repr, getattr(x, part).collect())) for x in (stored, direct)]
        assert side[0] == side[1], part
