"""Fuzzy name matching by words, without comparing every name with every student.

Two names of several words must agree on their first and last words, so words are compared and not names. The
distinct words of a class meet through blocks built from a bound on the ratio (see ``functions.similarity``): two words
that can reach the threshold share a block, so nothing is lost, and a very large class splits over many blocks.
Length and letter bounds are arithmetic on per-word numbers inside the join, and what survives is scored
once, however many classes or names have the two words. Names are then widened to the first words similar to
theirs, students to the last words that theirs is similar to, and both meet by an equi-join on scope and both words. Only
where a name or student has a single word do whole names take the place of words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkeeper.config import MATCHED, NEEDS_REVIEW, MatchConfig
from rollkeeper.functions.numeric import round2
from rollkeeper.functions.similarity import first_word, last_word, letter_mask, letters, may_reach, probe_letters, ratio
from rollkeeper.functions.text import normalize_name
from rollkeeper.session import stage

NAME_KEY = ["scope_id", "norm_name"]
# What a word is compared as: first and last words of names that both have several, whole names if the probe or only the student is one word.
FIRST, LAST, ONE_PROBE, ONE_STUDENT = "first", "last", "one_probe", "one_student"
Keep = Callable[[DataFrame], DataFrame]


def _has_two_words(name: Column) -> Column:
    return F.instr(name, " ") > 0


def _bound(config: MatchConfig) -> Column:
    kind = F.col("kind")
    return (
        F.when(kind == FIRST, F.lit(config.fuzzy_first_word))
        .when(kind == LAST, F.lit(config.fuzzy_last_word))
        .otherwise(F.lit(config.fuzzy_candidate))
    )


def name_words(names: DataFrame, name_col: str, probe_side: bool) -> DataFrame:
    """Distinct ``scope_id, kind, word`` of the names of one side."""
    name = F.col(name_col)
    word = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("word"))
    parts = [word(FIRST, first_word(name)), word(LAST, last_word(name))]
    if probe_side:
        words = F.when(_has_two_words(name), F.array(*parts, word(ONE_STUDENT, name))).otherwise(F.array(word(ONE_PROBE, name)))
    else:
        words = F.when(_has_two_words(name), F.array(*parts, word(ONE_PROBE, name))).otherwise(
            F.array(word(ONE_STUDENT, name), word(ONE_PROBE, name))
        )
    return names.select("scope_id", F.inline(words)).distinct()


def spelled_words(words: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Distinct ``kind, word`` with the ``mask`` and block ``keys`` of their letters, no more keys than letters."""
    # One projection per stage: each stage is used several times by the next.
    split = words.select("kind", "word").distinct().select("kind", "word", F.split("word", "").alias("chars"))
    spelled = split.select("kind", "word", letters(F.col("chars")).alias("letters"))
    return spelled.select("kind", "word", letter_mask(F.col("letters")).alias("mask"), probe_letters(F.col("letters"), _bound(config)).alias("keys"))


def similar_words(probes: DataFrame, students: DataFrame, config: MatchConfig = MatchConfig(), keep: Keep = stage) -> DataFrame:
    """``scope_id, kind, a, b`` of the words (``scope_id, kind, word``) of a scope that reach their bound."""
    # Whole names count only in scopes that have a single word on the other side.
    kinds = lambda side: side.select("scope_id", "kind").distinct()
    probes, students = (x.join(kinds(y), ["scope_id", "kind"], "left_semi") for x, y in ((probes, students), (students, probes)))
    probes, students = keep(probes), keep(students)
    # Stored, as the bounds below would otherwise work out the letters of both sides again for every use.
    spelled = keep(spelled_words(probes.unionByName(students), config))
    # Few rows can mean many pairs, so small inputs are spread as well.
    spread = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(side: DataFrame, word: str, mask: str) -> DataFrame:
        keyed = side.join(spelled, ["kind", "word"]).select("scope_id", "kind", F.col("word").alias(word), F.col("mask").alias(mask), F.explode("keys").alias("block"))
        return keyed.repartition(spread, "scope_id", "kind", "block")

    met = blocks(probes, "a", "mask_a").join(blocks(students, "b", "mask_b"), ["scope_id", "kind", "block"])
    met = met.filter(may_reach(F.col("a"), F.col("b"), F.col("mask_a"), F.col("mask_b"), _bound(config)))
    met = keep(met.select("scope_id", "kind", "a", "b").distinct())
    scored = met.select("kind", "a", "b").distinct().withColumn("ratio", ratio("a", "b")).filter(F.col("ratio") >= _bound(config))
    return met.join(scored, ["kind", "a", "b"]).select("scope_id", "kind", "a", "b", "ratio")


def candidate_pairs(names: DataFrame, students: DataFrame, config: MatchConfig = MatchConfig(), keep: Keep = stage) -> DataFrame:
    """Distinct ``scope_id, norm_name, erp_name`` pairs whose words agree, each with its ``whole`` ratio if it is known."""
    similar = keep(similar_words(name_words(names, "norm_name", True), name_words(students, "erp_name", False), config, keep))
    pairs = lambda kind, a, b: similar.filter(F.col("kind") == kind).select("scope_id", F.col("a").alias(a), F.col("b").alias(b))

    def words(side: DataFrame, name: str, first: str, last: str) -> DataFrame:
        several = side.filter(_has_two_words(F.col(name)))
        return several.select("scope_id", name, first_word(F.col(name)).alias(first), last_word(F.col(name)).alias(last))

    # Each side is widened by one word to the other side's, and both meet on the pair.
    left = words(names, "norm_name", "first_a", "last_a").join(pairs(FIRST, "first_a", "first_b"), ["scope_id", "first_a"])
    right = words(students, "erp_name", "first_b", "last_b").join(pairs(LAST, "last_a", "last_b"), ["scope_id", "last_b"])
    guarded = left.join(right, ["scope_id", "first_b", "last_a"]).select(*NAME_KEY, "erp_name", F.lit(None).cast("double").alias("whole"))
    single = similar.filter(F.col("kind").isin(ONE_PROBE, ONE_STUDENT))
    return guarded.unionByName(single.select("scope_id", F.col("a").alias("norm_name"), F.col("b").alias("erp_name"), F.col("ratio").alias("whole")))


def roster_names(roster: DataFrame) -> DataFrame:
    return roster.select(
        "scope_id", "roster_seq", "student_id", "roll_number", "name", normalize_name(F.col("name")).alias("erp_name")
    ).filter(F.col("erp_name") != "")


def scored_pairs(names: DataFrame, roster: DataFrame, config: MatchConfig = MatchConfig(), keep: Keep = stage) -> DataFrame:
    """Pairs at or above the candidate threshold with their score."""
    students = roster_names(roster).select("scope_id", "erp_name").distinct()
    pairs = keep(candidate_pairs(keep(names), keep(students), config, keep))
    known = pairs.filter(F.col("whole").isNotNull()).withColumnRenamed("whole", "score")
    a, b = F.col("norm_name"), F.col("erp_name")
    long_enough = F.lit(2.0) * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)) >= config.fuzzy_candidate - 1e-9
    asked = pairs.filter(F.col("whole").isNull() & long_enough).drop("whole")
    # Two names that meet in many classes are scored once.
    scores = asked.select("norm_name", "erp_name").distinct().withColumn("score", ratio("norm_name", "erp_name"))
    scores = scores.filter(F.col("score") >= config.fuzzy_candidate)
    return known.unionByName(asked.join(scores, ["norm_name", "erp_name"]).select(*NAME_KEY, "erp_name", "score"))


def fuzzy_students(names: DataFrame, roster: DataFrame, config: MatchConfig = MatchConfig(), keep: Keep = stage) -> DataFrame:
    """Every student at or above the threshold, for each name."""
    return scored_pairs(names, roster, config, keep).join(roster_names(roster), ["scope_id", "erp_name"])


def top_candidates(names: DataFrame, roster: DataFrame, config: MatchConfig = MatchConfig(), keep: Keep = stage) -> DataFrame:
    """The best students per name, by score then student id, one row each.

    Students with the same name score alike, so of one name only the first few by
    id can be among the best; both rank limits run before their shuffle too.
    """
    order = ["student_id", "roster_seq"]
    per_name = Window.partitionBy("scope_id", "erp_name").orderBy(*order)
    holders = (
        roster_names(roster)
        .withColumn("nth", F.row_number().over(per_name))
        .filter(F.col("nth") <= config.fuzzy_kept)
        .drop("nth")
    )
    ranked = Window.partitionBy(*NAME_KEY).orderBy(F.desc("score"), *order)
    return (
        scored_pairs(names, roster, config, keep)
        .join(holders, ["scope_id", "erp_name"])
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= config.fuzzy_kept)
        .select(*NAME_KEY, "rank", "score", "student_id", "roll_number", "name")
    )


def decide(candidates: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """One row per name: accept, or send to review with the best student filled in."""
    at = lambda rank, value: F.max(F.when(F.col("rank") == rank, F.col(value)))
    best = candidates.groupBy(*NAME_KEY).agg(
        F.count("*").alias("candidates_count"),
        at(1, "score").alias("best"),
        at(2, "score").alias("second"),
        at(1, "student_id").alias("student_id"),
        at(1, "roll_number").alias("roll_number"),
        at(1, "name").alias("name"),
    )
    ambiguous = F.coalesce((F.col("best") - F.col("second")) < config.fuzzy_margin, F.lit(False))
    accepted = ~ambiguous & (F.col("best") >= config.fuzzy_accept)
    weight = F.when(accepted, config.fuzzy_match_weight).otherwise(config.fuzzy_review_weight)
    best = best.withColumn("weighted", F.col("best") * weight)
    reason = F.when(ambiguous, "Ambiguous fuzzy match between multiple students.").when(
        ~accepted,
        F.concat(
            F.lit("Fuzzy match similarity ("), round2(F.col("best")).cast("string"), F.lit(") requires teacher review.")
        ),
    )
    return best.select(
        *NAME_KEY,
        "candidates_count",
        "best",
        F.struct("student_id", "roll_number", "name").alias("student"),
        F.when(accepted, MATCHED).otherwise(NEEDS_REVIEW).alias("resolution"),
        round2(F.col("weighted")).alias("match_confidence"),
        reason.alias("review_reason"),
    )
