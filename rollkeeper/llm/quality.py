"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose measure lies above a cutoff. The cutoffs are chosen on labelled documents, for
every stratum on its own. The cutoffs of a rule are tested in a fixed order, from the one that rejects least on, whether
the rate of falsely rejected good documents is below a limit with confidence; the first that fails ends the row, and the last
that passed is chosen. The bound is the exact binomial one (Clopper and Pearson). Tests in a fixed order need no correction among
themselves, so the error of confidence is divided by the number of rows, rules times strata, and all choices hold together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeeper.llm.common import BLANK, WORD, let, stage

c = F.col

# Rules: a measure of the counts and the grid of its cutoffs.
GRIDS = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0),
    "dup_line_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "long_words": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
    "short_words": (-5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0, -1.5),
}
# At most this part of the good documents of a stratum is falsely rejected, all rules together, with this error. With four strata a
# rule can act in those with about 1,500 good labels; a larger risk needs fewer.
RISK = 0.02
ERROR = 0.05
# The table of cutoffs is sent to every task up to this size; a larger one is met in so many parts of each stratum.
SENT_ROWS = 10_000
SENT_BYTES = 2_000_000
PARTS = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column) -> Column:
    """Words in windows of three that the text holds twice or more.

    Hashes of the windows are sorted; texts without two equal neighbours have none. For the rest, hashes are sorted
    with their places, and the places of equal neighbours, back in order, cover three words each or as many as the
    gap to the next place.
    """
    n = F.size(words)
    window = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def places(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def equal(s: Column) -> Column:
            same = F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)), x["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            )
            return let(
                F.sort_array(same),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x
                ),
            )

        return let(F.sort_array(pairs), equal)

    def count(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.get(s, k) == F.get(s, k - 1)))
        return F.when(F.size(hashes) < 2, F.lit(0).cast("long")).when(twice, places(hashes)).otherwise(F.lit(0).cast("long"))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(window, count))


def counts(docs: DataFrame) -> DataFrame:
    """All columns and the counts of the whole text in ``_q``: a struct of ``n_words`` and the four others."""
    text = F.coalesce(c("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    counted = docs.withColumn("_w", both)
    return counted.withColumn(
        "_q",
        F.struct(
            c("_w.n").alias("n_words"),
            F.length(F.regexp_replace(text, f"[{BLANK}]+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            c("_w.r").alias("n_repeat_words"),
        ),
    ).drop("_w")


def base_failed() -> Column:
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def measures() -> dict[str, Column]:
    """What the rules look at, from the counts; a text without words has zeros."""
    per_word = lambda x: F.when(c("n_words") > 0, x / c("n_words")).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": per_word(c("n_symbols")),
        "dup_line_share": per_word(c("n_dup_lines")),
        "repeat_share": per_word(c("n_repeat_words")),
        "long_words": per_word(c("word_chars")),
        "short_words": -per_word(c("word_chars")),
    }


def log_tail(n: Column, k: Column, rate: float) -> Column:
    """Logarithm of the binomial chance of at most ``k`` of ``n``, summed from the first term on."""
    odds = F.lit(rate / (1 - rate))
    start = n * F.log(F.lit(1 - rate))
    seed = F.struct(start.cast("double").alias("term"), start.cast("double").alias("all"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(term, acc["all"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(acc["all"] - top))).alias("all"))

    return F.when(k <= 0, start).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), seed, step)["all"])


def cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Chosen cutoffs, one row per stratum with a column per rule (null: the rule rejects nothing there).

    ``labelled`` has ``stratum``, ``quality`` and the counts. Every stratum with good labels stands for itself, null too.
    The limit of each rule is the risk divided by the number of rules, and the error of each test is the error divided
    by the number of rules and strata.
    """
    good = labelled.filter(c("quality") == 1).filter(~base_failed())
    limit = risk / len(GRIDS)
    tests = [
        F.sum((m > cut).cast("long")).alias(f"{rule}_{i}") for rule, m in measures().items() for i, cut in enumerate(GRIDS[rule])
    ]
    table = stage(good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *tests), "quality-tests")
    rows = max(1, table.count()) * len(GRIDS)
    # The upper bound of the rate lies below the limit just where seeing so few rejections would have less chance than the
    # error if the rate were the limit.
    passes = lambda k: (k <= c("n") * limit) & (log_tail(c("n"), k, limit) <= math.log(error / rows))

    def chosen(rule: str, grid: tuple) -> Column:
        # The higher the cutoff, the less it rejects.
        order = sorted(range(len(grid)), key=lambda i: -grid[i])
        tested = F.array(*[passes(c(f"{rule}_{i}")) for i in order])
        first_failed = let(tested, lambda t: F.array_position(t, F.lit(False)))
        cuts = F.array(*[F.lit(float(grid[i])) for i in order])
        last = F.when(first_failed == 0, F.lit(len(grid))).otherwise(first_failed - 1).cast("int")
        return F.get(cuts, last - 1).alias(rule)

    return table.select("stratum", *[chosen(rule, grid) for rule, grid in GRIDS.items()])


def _with_cutoffs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with ``_cut``, the cutoffs of their stratum, null without any; null is a stratum.

    A large table of strata is laid out by parts, which spreads a stratum that holds most of the rows.
    """
    size = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("stratum")).alias("bytes")).first()
    own = found.select(c("stratum").alias("_own"), F.struct(*GRIDS).alias("_cut"))
    same = c("_stratum").eqNullSafe(c("_own"))
    if size.n <= SENT_ROWS and (size.bytes or 0) <= SENT_BYTES:
        return rows.join(F.broadcast(own), same, "left")
    own = own.withColumn("_its", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(PARTS)).cast("int"))
    return rows.join(own, same & (c("_part") == c("_its")), "left")


def rejected_by(rule: str) -> Column:
    return F.coalesce(measures()[rule] > c(f"_cut.{rule}"), F.lit(False))


def judged(
    docs: DataFrame, labels: DataFrame, carried: tuple | None = None, stratum: str = "lang", risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """The columns ``carried`` (all by default) in a struct ``_row``, the counts, ``base_failed`` and ``kept``.

    The struct keeps columns of any name apart from the results. The rows come from a table in the shared folder.

    A document is kept if it passes the base rules and no rule rejects it by the cutoff of its stratum. A null or empty
    text has no words and fails. Labels that are null, repeated with another value or without a document are not
    used; repeated rows of a label count once. In a stratum without labels of its own, or where no test passes, only the
    base rules reject. An empty table gives an empty table.
    """
    carried = tuple(docs.columns if carried is None else carried)
    plain = docs.select(F.struct(*[docs[n] for n in carried]).alias("_row"), c("doc_id"), c("text"), c(stratum).cast("string").alias("_stratum"))
    rows = stage(counts(plain).select("_row", "doc_id", "_stratum", "_q.*"), "quality")
    marks = labels.filter(c("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    marks = marks.filter(c("quality") == c("_most")).drop("_most")
    seen = rows.select("doc_id", c("_stratum").alias("stratum"), *COUNTS).join(marks, "doc_id")
    found = stage(cutoffs(seen, risk, error), "quality-cutoffs")
    rows = _with_cutoffs(rows, found)
    bad = base_failed()
    for rule in GRIDS:
        rows = rows.withColumn(f"_by_{rule}", rejected_by(rule))
    kept = ~bad
    for rule in GRIDS:
        kept = kept & ~c(f"_by_{rule}")
    return rows.select("_row", *COUNTS, bad.alias("base_failed"), kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    rows = judged(docs, labels).filter("kept")
    return rows.select(*[c("_row")[n].alias(n) for n in docs.columns])
