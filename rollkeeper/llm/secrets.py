"""Secret scans: candidates in texts, and a random forest that tells secrets from false positives.

A candidate is a long run of characters that keys are made of, or, of any length and characters, a value after a key word
such as ``password``, the password of a URL, or a token of three dotted parts. Its length, the transitions between its characters, how
much of it common words cover, where its document comes from and the words next to it are what the forest looks at. It is
trained on labelled findings: those given as a table, and those whose standing their form shows. Values in a format that only keys
have are secrets; runs of letters, identifiers of the usual form, digests after a word that names one and encoded pictures
are false positives.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.llm.common import WORD, small_batches, some_of, stage
from rollkeeper.llm.neardup import _texts

c = F.col

LEAST = 16
# Words of the dictionary, and the bound of labelled findings of each kind that the forest is fitted on.
DICTIONARY_WORDS = 5_000
FINDINGS = 5_000
TREES = 20
DEPTH = 6
HASHED = 12
PLACES = 8
ACCEPT = 0.5

_CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{%d,}" % LEAST)
# Candidates by context: after a key word the quoted value, or what stands there up to white space or the next field; the password of a URL, up to
# the last @ before its path; and dotted web tokens.
_KEY_WORD = r"(?:token|secret|api[_-]?key|password|passwd|pwd)[\"']?\s*(?:=>|:=|[=:])\s*"
_KEYED = re.compile(_KEY_WORD + r"(?:\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)'|(\S+?)(?=\s|\Z|[&,;][\"']?(?:[A-Za-z_][\w.-]*(?:=|[\"']:)|" + _KEY_WORD + ")))", re.IGNORECASE)
_KEY_AGAIN = re.compile(_KEY_WORD + r"[\"']?(?=\S)", re.IGNORECASE)
_URL = re.compile(r"://[^\s/:@?#]*:([^\s/?#]+)@")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)")
_NAME_OF = re.compile(r"[A-Za-z0-9_-]*=")
_CLOSING = {")": "(", "]": "[", "}": "{", ">": "<"}
_VALUE = re.compile(r"^[A-Za-z_-]{2,20}=(?=.{8})")
_AROUND = re.compile(r"[A-Za-z]+")
# Public formats of keys, as the value and as the value with the text before it.
_KEY_FORMS = (re.compile(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), re.compile(r"^gh[pousr]_[A-Za-z0-9]{36}$"), re.compile(r"^xox[abprs]-[A-Za-z0-9-]{10,}$"))
_KEY_PLACES = (re.compile(r"(?:token|secret|api_?key)\s*[=:]\s*[\"']?$", re.IGNORECASE), re.compile(r"(?:password|passwd|pwd)\s*[=:]\s*[\"']?$", re.IGNORECASE))
_UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.IGNORECASE)
_DIGEST = re.compile(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$", re.IGNORECASE)
_DIGEST_PLACE = re.compile(r"(?:commit|md5|sha-?[0-9]*|digest|checksum|hash|revision|rev|etag|blob|tree)[\"']?\s*[=: ]\s*[\"']?$", re.IGNORECASE)
_PICTURE_PLACE = re.compile(r"image/[a-z+.-]+;base64,$", re.IGNORECASE)
_HEX = re.compile(r"^[0-9a-f]{16,64}$")


def split_name(found: str) -> tuple[str, str]:
    """Name and value of a candidate such as ``password=...``; the name is empty if it has none."""
    m = _VALUE.match(found)
    return (found[: m.end()], found[m.end() :]) if m else ("", found)


def spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of every candidate value, in order: those by context, and the long runs that are not just their parts.

    An unquoted value loses the marks at its end that close a sentence or what was opened before it.
    """
    found = set()
    for m in _KEYED.finditer(text):
        begin, end = m.span(m.lastindex)
        if m.lastindex == 3:
            again = _KEY_AGAIN.match(text, begin, end)
            while again:
                begin = again.end()
                again = _KEY_AGAIN.match(text, begin, end)
            begin += text[begin] in "\"'`" and end - begin > 1
            held = Counter(text[begin:end])
            while end > begin and (text[end - 1] in ",;.\"'`" or held[text[end - 1]] > (held[_CLOSING[text[end - 1]]] if text[end - 1] in _CLOSING else len(text))):
                end -= 1
                held[text[end]] -= 1
            if end == begin:
                continue
        found.add((begin, end))
    for pattern in (_URL, _DOTTED):
        found.update(m.span(1) for m in pattern.finditer(text))
    # The furthest end of any value up to each begin tells whether a run lies within one.
    known = sorted(found)
    begins, furthest, by_end = [b for b, _ in known], list(accumulate((e for _, e in known), max)), {e: b for b, e in reversed(known)}
    for m in _CANDIDATE.finditer(text):
        begin, end = m.start() + len(split_name(m[0])[0]), m.end()
        at = bisect_right(begins, begin)
        within = at and furthest[at - 1] >= end
        named = end in by_end and by_end[end] > begin and _NAME_OF.fullmatch(text, begin, by_end[end])
        if not within and not named:
            found.add((begin, end))
    return sorted(found)


def standing(value: str, before: str, words: frozenset[str] = frozenset()) -> int | None:
    """1 for values in the form of a key, 0 for runs of letters alone (short ones: common words), identifiers, named digests and
    encoded pictures, null for all others."""
    if any(p.match(value) for p in _KEY_FORMS) or _HEX.match(value) and any(p.search(before) for p in _KEY_PLACES):
        return 1
    if _UUID.match(value) or _DIGEST.match(value) and _DIGEST_PLACE.search(before) or _PICTURE_PLACE.search(before):
        return 0
    if len(value) < LEAST:
        return 0 if value.lower() in words else None
    return 0 if not re.search(r"[0-9]", value) and not re.search(r"[a-z][A-Z]", value) else None


def _kind(ch: str) -> int:
    return 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3


def features(value: str, before: str, after: str, place: str, words: frozenset[str]) -> list[float]:
    """Numbers for the forest."""
    n = len(value)
    kinds = [_kind(ch) for ch in value]
    shares = [kinds.count(k) / n for k in range(4)]
    moves = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    pairs = len({value[i : i + 2] for i in range(n - 1)}) / max(1, n - 1)
    low = value.lower()
    vowels = [ch in "aeiou" for ch in low]
    turns = sum(a != b for a, b in zip(vowels, vowels[1:])) / max(1, n - 1)
    entropy = -sum(k / n * math.log2(k / n) for k in (value.count(ch) for ch in set(value)))
    covered = np.zeros(n, dtype=bool)
    for size in (3, 4, 5, 6):
        for i in range(n - size + 1):
            if low[i : i + size] in words:
                covered[i : i + size] = True
    near = [0.0] * HASHED
    for word in _AROUND.findall(before)[-2:] + _AROUND.findall(after)[:1]:
        near[zlib.crc32(word.lower().encode()) % HASHED] += 1
    # Words of the path, hashed; a place without any has none.
    path = [0.0] * PLACES
    for word in _AROUND.findall(place):
        path[zlib.crc32(word.lower().encode()) % PLACES] += 1
    named = float(before.rstrip().endswith(("=", ":", '"', "'")))
    return [float(n), *shares, moves, pairs, turns, entropy, float(covered.mean()), named, *path, *near]


def dictionary(docs: DataFrame) -> frozenset[str]:
    """Common words of three to six letters of any script, by the number of all documents that have them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    words = docs.select(F.explode(F.filter(words, lambda w: w.rlike(r"^\p{L}{3,6}$"))).alias("word"))
    words = words.groupBy("word").count().orderBy(c("count").desc(), "word")
    return frozenset(r.word for r in words.limit(DICTIONARY_WORDS).collect())


def candidates(docs: DataFrame, words: frozenset[str]) -> DataFrame:
    """``doc_id, source, start, length, value_sha256, label, features`` of every candidate in the whole texts."""
    small_batches(docs.sparkSession)
    carried = ["doc_id", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which = [], []
            for i, (raw, source) in enumerate(zip(_texts(batch.column("text")), batch.column("source").to_pylist())):
                text = (raw or b"").decode()
                for begin, end in spans(text):
                    value, before, after = text[begin:end], text[max(0, begin - 60) : begin], text[end : end + 40]
                    which.append(i)
                    rows.append(
                        (
                            begin, len(value), hashlib.sha256(value.encode()).hexdigest(), standing(value, before, words),
                            features(value, before, after, str(source or ""), words),
                        )
                    )
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()))
            own = batch.select(carried).take(pa.array(which, pa.int64()))
            arrays = [*own.columns, *(pa.array(x, t) for x, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, "start", "length", "value_sha256", "label", "features"])

    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in carried)
    return docs.select(*carried, "text").mapInArrow(run, f"{kinds}, start bigint, length bigint, value_sha256 string, label int, features array<double>")


def findings(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, length, value_sha256, score, is_secret`` of every candidate; values themselves are not given out.

    ``labelled`` has ``doc_id, start, is_secret`` of findings that were judged; they go before what forms show, and labels without a
    candidate are not used. Null and empty texts have no candidates; starts are code points. Repeated rows are scanned each, and
    equal values are scored alike wherever they stand alike; a null source is a
    place of its own. Texts are taken whole, however long; extra columns are left out, an empty table gives an empty one. Where findings
    of one standing only, or none, are known, the score is their share of secrets.
    """
    found = candidates(docs, dictionary(docs))
    if labelled is not None:
        # A finding judged both ways is not used.
        judged = labelled.groupBy("doc_id", "start").agg(F.min(c("is_secret").cast("int")).alias("low"), F.max(c("is_secret").cast("int")).alias("high"))
        judged = judged.filter(c("low") == c("high")).select(c("doc_id").alias("_id"), c("start").alias("_start"), c("low").alias("judged"))
        found = found.join(judged, c("doc_id").eqNullSafe(c("_id")) & (c("start") == c("_start")), "left")
        found = found.withColumn("label", F.coalesce("judged", "label")).drop("_id", "_start", "judged")
    found = stage(found, "candidates")
    parts = [
        some_of(found.filter(c("label") == k), FINDINGS, "value_sha256", "doc_id", "start") for k in (0, 1)
    ]
    known = stage(parts[0].unionByName(parts[1]).select(c("label").cast("double").alias("label"), "features"), "findings")
    kinds = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(kinds) == 2:
        forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7)
        model = forest.fit(known.withColumn("vector", array_to_vector("features")))
        rows = model.transform(found.withColumn("vector", array_to_vector("features")))
        score = F.get(vector_to_array("probability"), F.lit(1))
    else:
        rows, score = found, F.lit(1.0 if 1.0 in kinds else 0.0)
    return rows.select("doc_id", "start", "length", "value_sha256", score.alias("score"), (score >= ACCEPT).alias("is_secret"))
