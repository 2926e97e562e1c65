"""Hard negatives by best-first search of sort-tile-recursive packed trees of boxes.

Components become whole numbers, floor(256 * x). Spark sorts the different vectors along the widest coordinate into
slabs of about ``SHARD``, and in each slab the vectors of every label are tiled along the next coordinates. A slab is a tree
of minimum bounding boxes: leaves of ``LEAF`` vectors and nodes of ``FANOUT`` boxes. A box
gives an interval for each coordinate, so an anchor's inner product with any vector in it lies between the sum of the
smaller and the sum of the larger products. A best-first queue opens the box with the highest possible score and
leaves boxes whose interval lies outside of the window of scores or strictly below the worst score still wanted, and
boxes that hold no label in question.

Two searches run over the trees: an anchor's positives, rows of its label without a window, and then, for each different
score of a positive, rows of other labels within the window that the score sets. Anchors meet the trees in blocks.

Equal scores go to the smaller id, so of a vector's ids only the smallest few can ever be returned; a vector keeps
those and counts as one entry, so a vector that a third of the rows have is compared once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeeper.llm.common import small_batches, stage

c = F.col

POSITIVES = 5
NEGATIVES = 5
# A negative's score is between these hundredths of the positive's.
LOW, HIGH = 80, 100
SCALE = 256
# Vectors in a tree and in a leaf, boxes in a node, anchors in a block.
SHARD = 8192
LEAF = 64
FANOUT = 8
BLOCK = 256
# Coordinates that slabs and tiles are sorted along.
AXES = 4
# The ids of one vector are first ranked in so many parts, as one vector may have most of them.
PARTS = 64
# Sums up to this size are exact in floating point.
EXACT = 1 << 53
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, one for each id (the least label and vector of repeated ids)."""
    v = c("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.filter(c("vec_id").isNotNull() & c("label").isNotNull() & v.isNotNull()).filter(finite)
    # Numbers beyond 64 bits end at the largest ones.
    whole = F.transform(v, lambda x: F.floor(x * SCALE))
    one = good.select("vec_id", F.struct(label.alias("label"), whole.alias("vector")).alias("row"))
    return one.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vector")


def moved_label() -> Column:
    """The label, one further where the id is divisible by 7."""
    label = c("label").cast("bigint")
    return F.when(c("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


def distinct(rows: DataFrame, ids: int) -> DataFrame:
    """``label, vector, ids`` of each different vector of a label, with the ``ids`` smallest of its ids in order."""
    part = W.partitionBy("label", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(part)).filter(c("nth") <= ids)
    least = first.withColumn("nth", F.row_number().over(W.partitionBy("label", "vector").orderBy("vec_id"))).filter(c("nth") <= ids)
    # At most ``ids`` rows are left of a vector.
    return least.groupBy("label", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _padded(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of 64-bit numbers; components that a shorter one lacks are 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def tile(points: np.ndarray, axes: list[int], leaf: int = LEAF) -> np.ndarray:
    """An order of the points in which every ``leaf`` in a row make a tile: sorted by one axis, cut into slabs, each sorted by the next."""
    order = np.arange(len(points))
    leaves = -(-len(points) // leaf)
    if leaves <= 1 or not axes:
        return order
    order = np.argsort(points[:, axes[0]], kind="stable")
    slabs = max(1, round(leaves ** (1 / len(axes))))
    width = -(-leaves // slabs) * leaf
    if len(axes) == 1:
        return order
    return np.concatenate([order[a : a + width][tile(points[order[a : a + width]], axes[1:], leaf)] for a in range(0, len(order), width)])


class BoxTree:
    """Boxes over points in tiled order: leaves of ``leaf`` points, and nodes of ``fanout`` boxes up to one root.

    Numbers are floating-point ones where all sums with the queries are exact in them, and Python's integers otherwise.
    """

    def __init__(self, points: np.ndarray, labels: np.ndarray, queries: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        most = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (points, queries)]
        kind = np.float64 if most[0] * most[1] * points.shape[1] < EXACT else object
        self.points, self.queries, self.labels, self.leaf, self.fanout = points.astype(kind), queries.astype(kind), labels, leaf, fanout
        low = high = self.points
        least = largest = labels
        up, down = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        # For each level from the leaves up: least and largest product of each query, least and largest label.
        self.levels, step = [], leaf
        while not self.levels or len(low) > 1:
            cuts = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            least, largest = np.minimum.reduceat(least, cuts), np.maximum.reduceat(largest, cuts)
            self.levels.append((self._held(up @ low.T + down @ high.T), self._held(up @ high.T + down @ low.T), least, largest))
            step = fanout

    def _held(self, scores: np.ndarray) -> np.ndarray:
        return np.clip(scores, -_LONG, _LONG) if scores.dtype == object else scores

    def search(self, k: int, label: int, same: bool, own: int, ids: list[list[int]], most: int, low: int | None, high: int | None, seen: dict) -> list[tuple[int, int]]:
        """``score, id`` of the ``most`` best entries for query ``k`` with a score from ``low`` to ``high``, best first.

        Entries have the label, or any other if not ``same``. ``seen`` keeps the scores of leaves that another search
        of the same query has opened.
        """
        top: list[tuple[int, int]] = []
        limit, level = low, len(self.levels) - 1
        agenda = [(-self.levels[level][1][k][0], level, 0)]
        while agenda:
            best, level, box = heapq.heappop(agenda)
            if limit is not None and (-best if high is None else min(-best, high)) < limit:
                # None of the others is better.
                break
            if level:
                least, largest, first, last = self.levels[level - 1]
                for child in range(box * self.fanout, min((box + 1) * self.fanout, len(first))):
                    fits = first[child] <= label <= last[child] if same else not first[child] == label == last[child]
                    if fits and (limit is None or largest[k][child] >= limit) and (high is None or least[k][child] <= high):
                        heapq.heappush(agenda, (-largest[k][child], level - 1, child))
                continue
            a, b = box * self.leaf, (box + 1) * self.leaf
            if box not in seen:
                seen[box] = self._held(self.points[a:b] @ self.queries[k])
            scores = seen[box]
            fits = (self.labels[a:b] == label) == same
            if limit is not None:
                fits &= (scores >= limit).astype(bool)
            if high is not None:
                fits &= (scores <= high).astype(bool)
            for i in np.flatnonzero(fits).tolist():
                for found in ids[a + i]:
                    entry = (int(scores[i]), -found)
                    if found == own:
                        continue
                    if len(top) < most:
                        heapq.heappush(top, entry)
                    elif entry > top[0]:
                        heapq.heapreplace(top, entry)
                    else:
                        break
            if len(top) == most:
                limit = top[0][0] if low is None else max(low, top[0][0])
        return [(s, -i) for s, i in sorted(top, reverse=True)]


class BoxIndex:
    """The different vectors of all rows in slabs; ``place`` orders the rows of a slab as their tree has them."""

    def __init__(self, rows: DataFrame, ids: int):
        small_batches(rows.sparkSession, 2000)
        self.kind = kind = rows.schema["vec_id"].dataType.simpleString()
        entries = stage(distinct(rows, ids), "box-entries")
        sizes = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
        self.size, slabs = sizes["size"] or 0, max(1, -(-sizes.n // SHARD))
        at = lambda i: F.coalesce(F.get("vector", F.lit(i)), F.lit(0))
        spread = [F.stddev_pop(at(i).cast("double")) for i in range(self.size)]
        wide = list(entries.agg(*spread).first()) if spread else []
        axes = sorted(range(self.size), key=lambda i: -(wide[i] or 0.0))[:AXES]
        # Slabs along the first coordinate; the next one and the id part equal ones.
        keys = [at(i) for i in axes[:2]] + [F.get("ids", F.lit(0))]
        size = self.size

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, place = [], 0, 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= 2 * SHARD:
                    yield tiled(held, place)
                    held, n, place = [], 0, place + n
            if n:
                yield tiled(held, place)

        def tiled(held: list[pa.RecordBatch], place: int) -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            points, labels = _padded(part.column("vector").chunk(0), size), part.column("label").to_numpy()
            order = [np.flatnonzero(labels == x) for x in np.unique(labels)]
            order = np.concatenate([rows[tile(points[rows], axes[1:])] for rows in order])
            part = part.take(pa.array(order)).append_column("place", pa.array(place + np.arange(len(order)), pa.int32()))
            return part.combine_chunks().to_batches()[0]

        dealt = entries.repartitionByRange(slabs, *keys).withColumn("slab", F.spark_partition_id())
        self.entries = stage(dealt.mapInArrow(packed, f"label bigint, vector array<bigint>, ids array<{kind}>, slab int, place int"), "box-index")
        self.slabs = (self.entries.agg(F.max("slab")).first()[0] or 0) + 1

    def search(self, asked: DataFrame, same: bool, most: int) -> DataFrame:
        """The best ``most`` of each row of ``query_id, label, vector, bases``: ``query_id, base, vec_id, score``.

        ``bases`` are scores that set a window each; null searches without one, and gives a null ``base``.
        """
        kind, size = self.kind, self.size
        blocks = max(1, -(-asked.count() // BLOCK))
        spread = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
        asked = asked.select("query_id", "label", "vector", "bases").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        asked = asked.withColumn("slab", F.explode(spread(self.slabs)))
        entries = self.entries.withColumn("block", F.explode(spread(blocks)))

        def meet(some: pa.Table, slab: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if len(some) and len(slab):
                slab = slab.sort_by("place").combine_chunks()
                queries = _padded(some.column("vector").combine_chunks(), size)
                tree = BoxTree(_padded(slab.column("vector").chunk(0), size), slab.column("label").to_numpy(), queries)
                ids, own, labels = slab.column("ids").to_pylist(), some.column("query_id").to_pylist(), some.column("label").to_pylist()
                for k, bases in enumerate(some.column("bases").to_pylist()):
                    seen: dict = {}
                    for base in [None] if bases is None else bases:
                        # The window of 100 * score, from LOW to HIGH times the base.
                        low, high = (None, None) if base is None else (-(-LOW * base // 100), HIGH * base // 100)
                        found = [] if base is not None and low > high else tree.search(k, labels[k], same, own[k], ids, most, low, high, seen)
                        out += [(own[k], base, i, s) for s, i in found]
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [some.schema.field("query_id").type, pa.int64(), some.schema.field("query_id").type, pa.int64()]
            return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["query_id", "base", "vec_id", "score"])

        met = asked.groupBy("block", "slab").cogroup(entries.groupBy("block", "slab"))
        found = met.applyInArrow(meet, f"query_id {kind}, base bigint, vec_id {kind}, score bigint")
        rank = F.row_number().over(W.partitionBy("query_id", "base").orderBy(c("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).filter(c("rank") <= most)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, label: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the ids divisible by ``every``.

    An anchor's positives are its best ``positives`` other rows of its label, ties to the smaller id; for each of them
    come the best ``negatives`` rows of other labels whose score is within the window that the positive's score sets. A negative
    score has an empty window, and so no rows. Rows without an id or label, and vectors that are null or hold null or
    non-finite components, take no part. Rows that repeat an id are one, with the least label and vector. Zero and
    empty vectors score 0; components that a shorter vector lacks count as 0; components and scores beyond 64
    bits count as the largest numbers of 64 bits. Extra columns are left out; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    rows = stage(usable(rows, c("label").cast("bigint") if label is None else label), "usable")
    index = BoxIndex(rows, max(positives + 1, negatives))
    asked = rows.filter(c("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    first = index.search(asked.withColumn("bases", F.lit(None).cast("array<bigint>")), True, positives)
    first = stage(first.select("query_id", c("vec_id").alias("positive_id"), c("score").alias("positive_score")), "positives")
    # At most as many scores as positives.
    bases = first.groupBy("query_id").agg(F.sort_array(F.collect_set("positive_score")).alias("bases"))
    second = index.search(asked.join(bases, "query_id"), False, negatives)
    second = second.select("query_id", c("base").alias("positive_score"), "rank", c("vec_id").alias("negative_id"), c("score").alias("negative_score"))
    found = first.join(second, ["query_id", "positive_score"])
    return found.select(c("query_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
