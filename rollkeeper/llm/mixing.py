"""Mixing sources to target weights with hash-threshold histograms.

Each document has a place between 0 and 1, the hexadecimal digits of a hash of its id. A source that is to give
a part of its words gives the documents placed below a threshold. The threshold is found from sums of words by
source and leading digits: the bucket in which the budget ends is the only one looked into more finely, digits
by digits, so no document is ever sorted and nothing but sums is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeeper.llm.common import WORD, stage

# Digits of a place that each level of histograms looks at, and the levels: 2 ** 48 places in all.
DIGITS = 3
LEVELS = 4
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
# The table of sources is sent to every task up to this size.
SENT_ROWS = 10_000
SENT_BYTES = 2_000_000

c = F.col


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column) -> Column:
    """Where a document stands in its source: digits that only depend on its id."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, DIGITS * LEVELS)


def _before(rows: DataFrame, order: list[Column], *values: str) -> DataFrame:
    """Add ``before_`` each value: its sum over all rows that come earlier in the order.

    Rows are dealt by ranges of the order; sums run inside a range, and those of whole ranges, as many as there are
    partitions, are added.
    """
    dealt = stage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_all_{v}") for v in values])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_all_{v}").over(earlier), F.lit(0)).alias(f"_earlier_{v}") for v in values])
    summed = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_inside_{v}") for v in values])
    found = [(c(f"_inside_{v}") + c(f"_earlier_{v}")).alias(f"before_{v}") for v in values]
    return summed.join(ranges, "_range").select(*rows.columns, *found)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Words wanted of each source, from ``source`` and ``source_size``.

    Sources weigh ``weights`` in turn by code point, null last, and share ``share`` times all words by weight. None
    gets more than ``most`` times its size; what it leaves is shared by the others. Those that stop are the first
    by room per weight, so running sums tell where the stopping ends. No task has all sources.
    """
    by_name = [c("source").asc_nulls_last()]
    room = _before(sizes.withColumn("one", F.lit(1)), by_name, "one")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (c("before_one") % len(weights) + 1).cast("int")).cast("long")
    room = room.withColumn("weight", weight).withColumn("room", c("source_size") * most).drop("one", "before_one")
    room = stage(_before(room, [(c("room") / c("weight")).asc(), *by_name], "room", "weight"), "mix-room")
    every = room.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    level = (F.lit(every.words * float(share)) - c("before_room")) / (F.lit(every.weights) - c("before_weight"))
    stops = c("room") <= level * c("weight")
    # One number: the share of a unit of weight for all sources that have more room.
    level = room.agg(F.max(F.when(~stops, level))).first()[0]
    wanted = F.least(c("room").cast("double"), F.lit(level).cast("double") * c("weight"))
    return room.select("source", "source_size", F.coalesce(wanted, c("room").cast("double")).alias("target"))


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Id, source, words and place of each document."""
    return docs.select(
        c(key).alias("doc_id"), c(source).cast("string").alias("source"), word_count(c(text)).alias("size"), place(c(key)).alias("place")
    )


def _digits(level: int) -> Column:
    return F.substring("place", 1 + DIGITS * level, DIGITS)


def thresholds(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row for each source: its size and target, the full copies, and the threshold below which one more is taken.

    In the last bucket that is looked into, the budget ends within documents of one place; they are taken if that
    comes nearer to the target.
    """
    first = rows.groupBy("source", _digits(0).alias("digits")).agg(F.sum("size").alias("words"))
    first = stage(first, "mix-histogram")
    goal = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    copies = F.when(c("source_size") > 0, F.floor(c("target") / c("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("copies", copies).withColumn("left", c("target") - c("copies") * c("source_size"))
    goal = stage(goal, "mix-targets")
    level_rows = first.withColumn("prefix", F.lit(""))
    budget = goal.select("source", "left", F.lit("").alias("prefix"))
    for level in range(LEVELS):
        order = W.partitionBy("source", "prefix").orderBy("digits").rowsBetween(W.unboundedPreceding, 0)
        run = _null_safe(level_rows, budget, ["source", "prefix"]).withColumn("upto", F.sum("words").over(order))
        before = c("upto") - c("words")
        edge = run.filter((before <= c("left")) & (c("upto") > c("left"))).select(
            "source", F.concat("prefix", "digits").alias("prefix"), (c("left") - before).alias("left"), "words"
        )
        if level < LEVELS - 1:
            budget = stage(edge.drop("words"), "mix-edge")
            near = rows.withColumn("prefix", F.substring("place", 1, DIGITS * (level + 1)))
            near = _null_safe(near, budget, ["source", "prefix"])
            level_rows = near.groupBy("source", "prefix", _digits(level + 1).alias("digits")).agg(F.sum("size").alias("words"))
    nearer = c("words") - c("left") < c("left")
    ended = edge.select("source", F.when(nearer, F.concat("prefix", F.lit("~"))).otherwise(c("prefix")).alias("threshold"))
    goal = _null_safe(goal, ended, ["source"], "left").withColumn("threshold", F.coalesce("threshold", F.lit("~")))
    return stage(goal.drop("left"), "mix-thresholds")


def _with_thresholds(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with what was found for their source; they hold ``source`` and ``place``.

    The table of sources is sent to every task if it is small. Otherwise each of its rows is laid out by leading
    digits, and rows meet it by source and digits, which spreads a source that holds most of them.
    """
    size = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("source")).alias("bytes")).first()
    if size.n <= SENT_ROWS and (size.bytes or 0) <= SENT_BYTES:
        return _null_safe(rows, F.broadcast(found), ["source"])
    digits = F.explode(F.transform(F.sequence(F.lit(0), F.lit(16**DIGITS - 1)), lambda n: F.lpad(F.lower(F.hex(n)), DIGITS, "0")))
    return _null_safe(rows.withColumn("digits", _digits(0)), found.withColumn("digits", digits), ["source", "digits"]).drop("digits")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null equals null."""
    other = right.select(*[c(k).alias(f"_{k}") for k in keys], *[k for k in right.columns if k not in keys])
    on = [c(k).eqNullSafe(c(f"_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """How many times each document is taken: id, source, size, source_size, target, times and taken words.

    Nulls: a null text has size 0, a null source is a source of its own that comes last, a null id has one place.
    Rows that repeat an id stand at the same place and are taken together. Sources without words and an empty table
    get targets of 0. Whether a document is taken depends on its id and the sums alone, so reruns agree.
    """
    rows = stage(sized(docs), "mix-sizes")
    joined = _with_thresholds(rows, thresholds(rows, weights, share, most))
    return joined.select(
        "doc_id", "source", "place", "size", "source_size", "target", _times(most).alias("times"), (_times(most) * c("size")).alias("taken")
    )


def _times(most: int) -> Column:
    """Full copies, and one more below the threshold."""
    return F.least(c("copies") + (c("place") < c("threshold")).cast("long"), F.lit(most).cast("long"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    rows = stage(sized(docs), "mix-sizes")
    found = thresholds(rows, weights, share, most).select("source", "copies", "threshold")
    marked = docs.select(
        F.struct(*[docs[n] for n in docs.columns]).alias("row"), c("source").cast("string").alias("source"), place(c("doc_id")).alias("place")
    )
    copies = _with_thresholds(marked, found).withColumn("times", _times(most).cast("int")).filter(c("times") > 0)
    return copies.select("row", F.explode(F.sequence(F.lit(1), c("times")))).select(*[c("row")[n].alias(n) for n in docs.columns])
