"""Suffix-array dedup: bytes covered by long strings that occur elsewhere, by column-wise multi-document construction.

Which suffixes need ordering against each other is settled first. Every string of ``LENGTH`` bytes has an anchor, the
leftmost of its grams with the least hash; equal strings have equal anchors at equal distance. The starts that share
an anchor, with the bytes that their strings cover, are a slice, and only slices of equal anchors can hold equal
strings, and only at equal distance from it. So the slices of an anchor are the documents of a collection that is built
column by column, from the right: each round inserts one symbol per slice, the symbols in the order of the suffixes
behind them being the round's column of the collection's Burrows-Wheeler transform; sorting it stably gives the order
of the longer suffixes, and the common prefixes follow from minima over the old ones. Columns are read one after
the other, once. Neighbours with a common prefix of ``LENGTH`` are repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.llm.common import small_batches, stage
from rollkeeper.llm.neardup import _steps, _texts
from rollkeeper.llm.shingles import mix

c = F.col

LENGTH = 400
GRAM = 16
REACH = LENGTH - GRAM
# Slices built side by side, and slices of one anchor in one collection; larger ones are split and merged by string.
SIDE_BY_SIDE = 8192
COLLECTION = 4096
_PLACE_BITS = np.uint64(22)
_SEGMENT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text number, hash of the anchor, its place, first and last start, all in the text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    data = np.frombuffer(b"".join(texts) + b"\0" * GRAM, dtype=np.uint8)
    eights = np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data.data, strides=(1,)) if total else None
    found = []
    for s in range(0, total, _SEGMENT):
        n = min(_SEGMENT, total - s)  # starts in this segment
        grams = min(n + REACH, total - s)
        h = mix(mix(eights[s : s + grams] * _ODD + np.uint64(LENGTH)) + eights[s + 8 : s + 8 + grams] * _ODD)
        ranked = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(grams, dtype=np.uint64)
        width = REACH + 1
        padded = np.full(-(-(n + width) // width) * width + width, np.iinfo(np.uint64).max)
        padded[:grams] = ranked
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(behind[:n], ahead[REACH : REACH + n])
        starts = np.arange(s, s + n)
        text = np.searchsorted(ends, starts, side="right")
        good = starts + LENGTH <= ends[text]
        starts, text, least = starts[good], text[good], least[good]
        if not len(starts):
            continue
        place = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
        own = begins[text[first]]
        found.append((text[first], h[place[first]].view(np.int64), place[first] + s - own, starts[first] - own, starts[last] - own))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def repeated_starts(group: np.ndarray, left: np.ndarray, slices: list[bytes], seen=None) -> np.ndarray:
    """Which strings of each slice occur in another slice of its group: rows of slices, columns from ``-REACH`` to 0.

    ``left`` is where a slice begins, counted from its anchor; ``group`` numbers must be in order. ``seen(order, common)``
    is told each column's order of the slices and the common prefixes, once the column's strings are complete.
    """
    n, columns = len(slices), REACH + LENGTH
    sizes = np.array([len(s) for s in slices], dtype=np.int64)
    table = np.zeros((columns, n), dtype=np.uint16)
    flat = np.frombuffer(b"".join(slices), dtype=np.uint8)
    who = np.repeat(np.arange(n), sizes)
    table[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left + REACH, sizes), who] = flat.astype(np.uint16) + 1
    order, common = np.arange(n), np.zeros(n + 1, dtype=np.int32)
    found = np.zeros((n, REACH + 1), dtype=bool)
    last = left + sizes - LENGTH
    for t in range(columns - 1, -1, -1):
        transform = table[t][order]
        key = group[order] * 257 + transform
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = np.flatnonzero((key[1:] == key[:-1]) & (transform[moved[1:]] > 0))
        longer = np.zeros(n + 1, dtype=np.int32)
        if len(same):
            between = np.empty(2 * len(same), dtype=np.int64)
            between[0::2], between[1::2] = moved[same] + 1, moved[same + 1] + 1
            longer[same + 1] = np.minimum(np.minimum.reduceat(common, between)[::2] + 1, LENGTH)
        order, common = order[moved], longer
        if t <= REACH:
            full = common >= LENGTH
            hit = order[full[:-1] | full[1:]]
            d = t - REACH
            found[hit[(left[hit] <= d) & (d <= last[hit])], t] = True
            if seen is not None:
                seen(t, order, common)
    return found


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    new = np.flatnonzero(np.diff(starts, prepend=starts[0] - 2) != 1)
    return starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]


ROW = ["doc_id", "text_mark"]


def _schema(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_mark int, {rest}"


def _built(bucket: pa.Table) -> pa.Table:
    """Repeated starts of the slices that occur once, as spans; of split collections also strings that another part may have."""
    bucket = bucket.sort_by([("key", "ascending"), ("part", "ascending")])
    key, part = bucket.column("key").to_numpy(), bucket.column("part").to_numpy()
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    place = bucket.column("place").to_numpy().astype(np.int64)
    left = bucket.column("first").to_numpy() - place
    slices = bucket.column("slice").to_pylist()
    split, once = bucket.column("parts").to_numpy() > 1, bucket.column("n").to_numpy() == 1
    who, first, last, string = [], [], [], []

    def strings(t: int, order: np.ndarray, common: np.ndarray) -> None:
        """One string of each class of equal ones; it has a start only if the class and the slice have no other."""
        d = t - REACH
        for r in np.flatnonzero(split[order] & (common[:-1] < LENGTH)):
            i = order[r]
            if left[i] <= d <= left[i] + len(slices[i]) - LENGTH:
                alone = once[i] and common[r + 1] < LENGTH
                who.append(i)
                first.append(int(place[i] + d) if alone else -1)
                last.append(first[-1])
                string.append(hashlib.blake2b(slices[i][d - left[i] : d - left[i] + LENGTH], digest_size=16).digest())

    found = repeated_starts(np.cumsum(new) - 1, left, slices, strings if split.any() else None)
    for i in np.flatnonzero(found.any(axis=1) & once):
        for a, b in zip(*_spans(np.flatnonzero(found[i]) - REACH + place[i])):
            who.append(i)
            first.append(int(a))
            last.append(int(b))
            string.append(None)
    rows = bucket.select(ROW).take(pa.array(who, pa.int64()))
    spans = [pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(string, pa.binary())]
    return pa.Table.from_arrays([*rows.columns, *spans], names=[*ROW, "first", "last", "string"])


def _anchored(docs: DataFrame) -> DataFrame:
    """Runs of starts with their anchors, and a hash of the slice that each covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column("text"))
            for a, b in _steps([len(t) for t in texts]):
                text, key, place, first, last = anchors(texts[a:b])
                some = texts[a:b]
                cover = [
                    hashlib.blake2b(some[i][x : y + LENGTH], digest_size=8).digest() for i, x, y in zip(text.tolist(), first.tolist(), last.tolist())
                ]
                rows = batch.slice(a, b - a).select(ROW).take(pa.array(text))
                numbers = [pa.array(n, pa.int32()) for n in (place, first, last)]
                cover = pa.array(np.frombuffer(b"".join(cover), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key), cover, *numbers], names=[*ROW, "key", "cover", "place", "first", "last"])

    schema = _schema(docs, "key bigint, cover bigint, place int, first int, last int")
    return docs.filter(F.octet_length("text") >= LENGTH).mapInArrow(run, schema)


def _sliced(rows: DataFrame) -> DataFrame:
    """Each run of a row with the bytes that it covers."""
    names = ["key", "n", "variants", "place", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(_texts(batch.column("text"))):
                runs = pa.RecordBatch.from_struct_array(batch.column("runs")[i].values)
                cuts = [text[a : b + LENGTH] for a, b in zip(runs.column("first").to_pylist(), runs.column("last").to_pylist())]
                own = batch.select(ROW).take(pa.array([i] * len(cuts), pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, *(runs.column(n) for n in names), pa.array(cuts, pa.binary())], names=[*ROW, *names, "slice"])

    schema = _schema(rows, "key bigint, n bigint, variants bigint, place int, first int, slice binary")
    return rows.select(*ROW, "text", "runs").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans of starts of repeated strings: ``doc_id, text_mark, first, last``; ``docs`` has the first two and ``text``.

    Slices that several runs have in common are repeated as a whole, so only one of them is built, to hold the others
    of its anchor against, and anchors all of whose slices are equal need no building.
    """
    runs = stage(_anchored(docs), "anchors")
    shared = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cover").alias("low"), F.max("cover").alias("high"))
    shared = shared.filter(c("n") > 1).select("key", (c("low") == c("high")).alias("equal"))
    runs = stage(runs.join(shared, "key"), "shared")
    mixed = runs.filter(~c("equal"))
    variants = mixed.groupBy("key", "cover").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "place", "first", "last")).alias("run"))
    variants = stage(variants, "variants")
    more = variants.filter(c("n") > 1).select("key", "cover")
    whole = runs.filter("equal").unionByName(mixed.join(more, ["key", "cover"])).select(*ROW, "first", "last")
    keys = variants.groupBy("key").agg(F.count(F.lit(1)).alias("variants"), F.min("n").alias("least"))
    keys = keys.filter(c("least") == 1).drop("least")
    wanted = stage(variants.join(keys, "key").select("run.*", "key", "n", "variants"), "wanted")
    size = wanted.count()
    wanted = wanted.groupBy(c("doc_id").alias("_id"), c("text_mark").alias("_mark")).agg(
        F.collect_list(F.struct("key", "n", "variants", "place", "first", "last")).alias("runs")
    )
    one = docs.join(wanted, c("doc_id").eqNullSafe(c("_id")) & (c("text_mark") == c("_mark"))).dropDuplicates(["_id", "_mark"])
    slices = _sliced(one)
    parts = F.ceil(c("variants") / COLLECTION)
    slices = slices.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(*ROW, "place"), parts)).drop("variants")
    slices = slices.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(-(-size // SIDE_BY_SIDE) + 1)))
    built = slices.groupBy("bucket").applyInArrow(_built, _schema(docs, "first int, last int, string binary"))
    built = stage(built, "spans")
    strings = built.filter(c("string").isNotNull())
    again = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    across = strings.filter(c("first") >= 0).join(again, "string").select(*ROW, "first", "last")
    return built.filter(c("string").isNull()).select(*ROW, "first", "last").unionByName(across).unionByName(whole)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) and ``kept_sha256`` of every row.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere, in the same text or in any other row;
    strings are those of the input. Rows with equal texts repeat all of them. Null counts as empty; texts shorter than
    that stay whole, and so do the bytes around spans, even if they are no UTF-8 on their own. Extra columns are left
    out; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession, 200)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.hash(text).alias("text_mark"), text.alias("text"))
    # Rows are told apart by their id and a mark of their text, as ids may repeat.
    spans = repeated_spans(docs).groupBy(c("doc_id").alias("_id"), c("text_mark").alias("_mark"))
    spans = spans.agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = docs.join(spans, c("doc_id").eqNullSafe(c("_id")) & (c("text_mark") == c("_mark")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(_texts(batch.column("text")), batch.column("spans").to_pylist()):
                edges = np.zeros(len(text) + 1, dtype=np.int32)
                if spans:
                    np.add.at(edges, [s["first"] for s in spans], 1)
                    np.add.at(edges, [s["last"] + LENGTH for s in spans], -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if spans else text
                starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if spans else 0
                out.append((len(text), len(text) - len(kept), starts, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
