"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Documents with equal shingle sets are one node from the start, so copies never pair. Nodes meet in bands of their
signatures, which are taken in a few rounds. In each bucket of a round one node of each present component is held against one
other node only, so a family of near copies that the first bands have joined costs next to nothing in the others. Of buckets
whose members are at last not
all in one component, nodes with too many shingles that no other candidate has can have no link and go. The others
are gathered, with all nodes that share a bucket with them directly or over others, and held against each other in
blocks of bounded size, which give a forest of links and not their pairs. A link always rests on the full sets, made
anew from both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.llm.common import small_batches, stage
from rollkeeper.llm.shingles import PLACES, set_digest, shingle_sets, super_minhash

c = F.col

PERCENT = 75
# 32 bands of 4 places: a pair of similarity 0.75 is missed by all of them once in 190,000 times.
BANDS = 32
ROWS = PLACES // BANDS
# The bands of a round end here.
ROUNDS = (4, BANDS)
# Signatures that agree in fewer places than this rule a pair out: five standard deviations below the limit.
LEAST_AGREEING = round(PLACES * (PERCENT / 100 - 5 * (PERCENT / 100 * (1 - PERCENT / 100) / PLACES) ** 0.5))
# Nodes and shingles in one half of a block.
HALF_NODES = 512
HALF_SHINGLES = 200_000
BYTES_AT_ONCE = 1_500_000
# Links that a single task joins.
LINKS_AT_ONCE = 250_000


def _steps(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes, so that memory follows the longest text and not the batch."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= BYTES_AT_ONCE:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, and of documents with words ``node``, the digest of the set, and ``signature``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column("text"))
            for a, b in _steps([len(t or b"") for t in texts]):
                values, begins = shingle_sets(texts[a:b])
                # Two bytes of each place are enough to tell whether signatures agree there.
                marks = (super_minhash(values, begins) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype("<u2")
                sizes = np.diff(begins)
                nodes = [set_digest(values[i:j]) if j > i else None for i, j in zip(begins[:-1], begins[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("text_key").slice(a, b - a),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.binary()),
                        pa.array([m.tobytes() if n else None for m, n in zip(marks, sizes)], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "node", "signature"],
                )

    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key binary, n_shingles bigint, node binary, signature binary")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures do not rule them out."""
    half = lambda side: nodes.select(c("node").alias(side), c("signature").alias(f"s{side}"))
    both = pairs.join(half("a"), "a").join(half("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype="<u2").reshape(-1, PLACES) for n in ("sa", "sb")
            )
            keep = pa.array((left == right).sum(axis=1) >= LEAST_AGREEING)
            yield batch.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    half = lambda side: texts.select(c("node").alias(side), c("text").alias(f"t{side}"))
    both = pairs.join(half("a"), "a").join(half("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _texts(batch.column("ta")), _texts(batch.column("tb"))
            keep = np.zeros(len(left), dtype=bool)
            for a, b in _steps([len(x) + len(y) for x, y in zip(left, right)]):
                x, xs = shingle_sets(left[a:b])
                y, ys = shingle_sets(right[a:b])
                for k in range(b - a):
                    mine, other = x[xs[k] : xs[k + 1]], y[ys[k] : ys[k + 1]]
                    if min(len(mine), len(other)) * 100 < PERCENT * max(len(mine), len(other)):
                        continue
                    common = len(np.intersect1d(mine, other, assume_unique=True))
                    keep[a + k] = 100 * common >= PERCENT * (len(mine) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


class UnionFind:
    """Groups of nodes; the smallest node of a group is its root."""

    def __init__(self) -> None:
        self.parent: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: bytes, b: bytes) -> bool:
        """Join two groups; whether they were apart."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in a link: the smallest node that it reaches.

    Each task joins the links it reads by union-find and gives on a forest of stars. So few of these that one task holds
    them are joined there once more; any more are settled over all tasks by taking the smallest root among neighbours and
    following roots, until no root changes.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                groups.join(a, b)
        nodes = list(groups.parent)
        for i in range(0, len(nodes), 10_000):
            part = nodes[i : i + 10_000]
            roots = [groups.find(x) for x in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(roots, pa.binary())], names=["a", "b"])

    stars = stage(links.select("a", "b").mapInArrow(forest, "a binary, b binary"), "stars")
    if stars.count() <= LINKS_AT_ONCE:
        whole = stars.repartition(1).mapInArrow(forest, "a binary, b binary")
        return stage(whole.select(c("a").alias("node"), c("b").alias("root")), "roots")
    ways = stage(stars.unionByName(stars.select(c("b").alias("a"), c("a").alias("b"))).distinct(), "links")
    roots = stage(ways.groupBy(c("a").alias("node")).agg(F.min("b").alias("root")), "roots")
    while True:
        around = ways.join(roots.select(c("node").alias("b"), c("root").alias("next")), "b").groupBy("a").agg(F.min("next").alias("next"))
        nearer = roots.join(around, c("node") == c("a")).select("node", "root", F.least("root", "next").alias("next"))
        nearer = stage(nearer, "nearer")
        jump = nearer.select(c("node").alias("next"), c("next").alias("far"))
        moved = nearer.join(jump, "next", "left").select("node", c("root").alias("was"), F.least("next", F.coalesce("far", "next")).alias("root"))
        moved = stage(moved, "roots")
        roots = moved.select("node", "root")
        if moved.filter(c("was") != c("root")).isEmpty():
            return roots


def _apart(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket, node, n, root`` of buckets that hold several components."""
    placed = _with_roots(members.select("bucket", "node"), roots)
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(c("low") != c("high"))
    placed = placed.join(several.select("bucket"), "bucket").join(nodes.select("node", "n"), "node")
    return stage(placed.select("bucket", "node", "n", "root"), "apart")


def _may_link(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows whose node shares enough of its shingles with other candidates: two sets have no more in common than that."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column("text"))
            for a, b in _steps([len(t) for t in texts]):
                values, begins = shingle_sets(texts[a:b])
                owner = np.repeat(np.arange(a, b), np.diff(begins))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(owner)), pa.array(values.view(np.int64))], names=["node", "shingle"]
                )

    held = texts.join(apart.select("node").distinct(), "node").select("node", "text").mapInArrow(shingles, "node binary, shingle bigint")
    alone = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("node")).filter(c("nodes") == 1)
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    rows = apart.join(alone, "node", "left")
    return rows.filter((c("n") - F.coalesce("alone", F.lit(0))) * 100 >= c("n") * PERCENT).drop("alone")


def _compare(block: pa.Table) -> pa.Table:
    """A forest of the links between different components in every block of a table."""
    block = block.sort_by([("family", "ascending"), ("low", "ascending"), ("high", "ascending")])
    families, lows, highs = (block.column(n).to_pylist() for n in ("family", "low", "high"))
    nodes, roots, texts = block.column("node").to_pylist(), block.column("root").to_pylist(), _texts(block.column("text").combine_chunks())
    edges = [i for i in range(len(nodes)) if i == 0 or (families[i], lows[i], highs[i]) != (families[i - 1], lows[i - 1], highs[i - 1])]
    left, right = [], []
    for a, b in zip(edges, [*edges[1:], len(nodes)]):
        groups = UnionFind()
        values, begins = shingle_sets(texts[a:b])
        sizes = np.diff(begins)
        _, which, times = np.unique(values, return_inverse=True, return_counts=True)
        owner, shared = np.repeat(np.arange(b - a), sizes), times[which] > 1
        number = (np.cumsum(times > 1) - 1)[which]
        order = np.argsort(number[shared], kind="stable")
        column, row = number[shared][order], owner[shared][order]
        common = np.zeros((b - a, b - a), dtype=np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            x, y = np.searchsorted(column, [start, start + 4096])
            part = np.zeros((b - a, 4096), dtype=np.float32)
            part[row[x:y], column[x:y] - start] = 1
            common += part @ part.T
        close = 100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)
        for i, j in zip(*(k.tolist() for k in np.nonzero(np.triu(close, 1)))):
            if roots[a + i] != roots[a + j] and groups.join(roots[a + i], roots[a + j]):
                left.append(nodes[a + i])
                right.append(nodes[a + j])
    return pa.Table.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def _links_in_blocks(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components that share a bucket, by comparing families of nodes in blocks of two halves each."""
    rows = stage(_may_link(apart, texts), "may-link")
    ties = rows.select(c("node").alias("a"), F.unhex(F.hex("bucket")).alias("b"))
    family = components(ties).withColumnRenamed("root", "family")
    rows = rows.select("node", "n", "root").distinct().join(family, "node")
    sizes = rows.groupBy("family").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("all"), F.min("root").alias("one"), F.max("root").alias("two"))
    halves = F.greatest(F.ceil(c("nodes") / HALF_NODES), F.ceil(c("all") / HALF_SHINGLES))
    sizes = sizes.filter(c("one") != c("two")).select("family", halves.alias("halves"))
    rows = rows.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("node"), c("halves")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), c("halves") - 1)))
    # With several halves, those of one half meet each other in the blocks that it shares with the others.
    rows = rows.filter((c("own") != c("other")) | (c("halves") == 1))
    rows = stage(rows.select("family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "root"), "blocks")
    tables = -(-rows.count() // HALF_NODES) + 1
    rows = rows.withColumn("table", F.pmod(F.xxhash64("family", "low", "high"), F.lit(tables))).join(texts, "node")
    return stage(rows.groupBy("table").applyInArrow(_compare, "a binary, b binary"), "block-links")


def _pivot_pairs(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs ``a, b``: in each bucket the smallest node, and the smallest node of every other component."""
    placed = members.withColumn("root", c("node")) if roots is None else _with_roots(members, roots)
    first = placed.groupBy("bucket", "root").agg(F.min("node").alias("node"))
    several = first.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).filter(c("size") > 1)
    pairs = first.join(several, "bucket").filter(c("node") != c("pivot"))
    return pairs.select(c("pivot").alias("a"), c("node").alias("b")).distinct()


def _first_roots(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each is held against in two steps at most, so those with one root are connected."""
    up = links.groupBy(c("b").alias("node")).agg(F.min("a").alias("root"))
    further = up.select(c("node").alias("root"), c("root").alias("far"))
    return up.join(further, "root", "left").select("node", F.coalesce("far", "root").alias("root"))


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` of every row; ``text_key`` is a digest of the text.

    A null text, or one without words, is linked with nothing: its component is its own id. Rows that repeat an id are
    nodes by their texts; both have the smallest id of their component. A null id is larger than all others and stands
    for a component only if there is no other. ``kept`` marks the rows whose id is that of the component, and one row
    per component only if ids do not repeat. Extra columns are left out, an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    marks = stage(signatures(docs), "signatures")
    nodes = marks.filter(c("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    nodes = stage(nodes, "nodes")
    hashes = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * 2 * ROWS + 1, F.lit(2 * ROWS))))
    bands = nodes.select("node", F.posexplode(hashes).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(c("size") > 1)
    members = stage(bands.join(shared, "bucket").select("band", "bucket", "node"), "members")
    texts = _candidate_texts(docs, members, nodes)
    links = roots = None
    for first, last in zip((0, *ROUNDS), ROUNDS):
        tried = stage(_agreeing(_pivot_pairs(members.filter(c("band").between(first, last - 1)), roots), nodes), "pairs")
        found = stage(_verified(tried, texts), "verified")
        links = found if links is None else links.unionByName(found)
        roots = _first_roots(links)
    roots = components(links)
    apart = _apart(members, nodes, roots)
    if not apart.isEmpty():
        roots = components(links.unionByName(_links_in_blocks(apart, texts)))
    named = _with_roots(nodes.select("node", "doc_id"), roots)
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(lowest, "root").select("node", "component_id")
    out = marks.select("doc_id", "text_key", "n_shingles", "node").join(named, "node", "left")
    component = F.when(c("node").isNull(), c("doc_id")).otherwise(c("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), c("doc_id").eqNullSafe(component).alias("kept"))


def _candidate_texts(docs: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """A text of each node that shares a bucket: ``node, text``."""
    wanted = nodes.join(members.select("node").distinct(), "node").select(c("node"), c("doc_id").alias("id"))
    texts = docs.join(wanted, c("doc_id").eqNullSafe(c("id"))).select("node", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An id may repeat with other texts.
        for batch in batches:
            texts = _texts(batch.column("text"))
            keep = np.zeros(len(texts), dtype=bool)
            for a, b in _steps([len(t or b"") for t in texts]):
                values, begins = shingle_sets(texts[a:b])
                for k, node in enumerate(batch.column("node").slice(a, b - a).to_pylist()):
                    keep[a + k] = begins[k + 1] > begins[k] and set_digest(values[begins[k] : begins[k + 1]]) == node
            yield batch.filter(pa.array(keep))

    return stage(texts.mapInArrow(own, "node binary, text string").dropDuplicates(["node"]), "texts")


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns; documents without words stay.

    Of rows that repeat both id and text, one stays.
    """
    found = near_duplicates(docs).filter("kept").select(c("doc_id").alias("_id"), c("text_key").alias("_key")).distinct()
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("row"), "doc_id", key.alias("key"))
    rows = rows.join(found, c("doc_id").eqNullSafe(c("_id")) & (c("key") == c("_key")))
    return rows.dropDuplicates(["_id", "_key"]).select(*[c("row")[n].alias(n) for n in docs.columns])
