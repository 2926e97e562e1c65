"""Information-theoretic sanitisation: personal data, and the terms that give it away.

Fixed patterns find e-mail and IP addresses, card and phone numbers; each value is a protected entity c. A term t, a
word or two words in a row, discloses c by as much as their co-occurrence over all documents says: of the information
IC(c) = log2(N / n(c)) that c carries, t gives PMI(c; t) = log2(N * n(c, t) / (n(c) * n(t))), and IC - PMI, which is
log2(n(t) / n(c, t)), is left. Here n(c, t) counts the documents where t stands within ``REACH`` words of c. A term that
leaves ``REMOVE_BITS`` or less of some entity is removed wherever it stands, one that leaves ``GENERALISE_BITS`` or
less is replaced by its kind, if it gives at least the part ``SHARE`` of the information (words that are as common elsewhere give none)
and has been seen with the entity in ``CONTEXTS`` different surroundings (copies of one passage tell nothing new).

Two passes read the documents: the first gives the surroundings of entities, the second the spans of personal data and of the
terms seen in enough surroundings, whose documents are then counted. What terms the second looks for goes along
as a Bloom filter of fixed size; what passes it is joined exactly, so the number of terms has no bound.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.llm.common import small_batches, stage

c = F.col

# The kinds and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Numbers with single dots between them: addresses are four in a row, the next ones after the last of these.
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGIT = re.compile(r"[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]++")
_PHONE_TAIL = " ().-"

REACH = 6
CONTEXTS = 4
REMOVE_BITS = 0.5
GENERALISE_BITS = 1.0
SHARE = 0.5
# Kinds of the spans that the method adds.
REMOVED, GENERALISED = "removed", "generalised"
_WORD = re.compile(r"[^\W_]+")
# Bits of a filter, and where the places of a term are taken from its hash.
FILTER_BITS = 1 << 23
SHIFTS = (0, 20, 40)
# Words whose filter result is remembered.
WORDS_KNOWN = 400_000
# Before a word that is a term looked for, or part of one.
PART = "\x01"
_PART = PART.encode()

# ASCII characters that no word has, as blanks.
_PIECES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    """An @ sign with what stands before and after it; before it nothing of an earlier match or beyond an earlier sign."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        low = domain.end() if domain else at + 1
        at = text.find("@", low)
    return out


def _digits(value: str) -> str:
    return "".join(ch for ch in value if ch in "0123456789")


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(doubled) + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def _phone_end(match: re.Match) -> int:
    return match.start() + len(match.group().rstrip(_PHONE_TAIL))


def _addresses(text: str) -> Iterator[Span]:
    for m in _NUMBERS.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            short = [p.lstrip("0") for p in parts[i : i + 4]]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in short):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind (its place in ``KINDS``), start and end of the personal data, in time linear in the text."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(1, a, b) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        # At most every second character is no digit.
        if 13 <= m.end() - m.start() <= 2 * 19 and 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        end = _phone_end(m)
        if end - m.start() >= 4 and 9 <= len(_digits(text[m.start() : end])) <= 15:
            out.append((3, m.start(), end))
    return out


def _entity(kind: int, value: str) -> int:
    """A number for a value; how a number is written does not matter."""
    value = value.lower() if kind == 0 else value if kind == 1 else _digits(value)
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def _without(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans blanked, each character by one."""
    if not spans:
        return text
    parts, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if b > at:
            a = max(a, at)
            parts += [text[at:a], "\n" * (b - a)]
            at = b
    return "".join([*parts, text[at:]])


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), *m.span()) for m in _WORD.finditer(text)]


def _pairs(text: str, tokens: list[tuple[str, int, int]]) -> Iterator[int]:
    """The tokens that are followed by another after one space."""
    for i in range(len(tokens) - 1):
        if tokens[i + 1][1] == tokens[i][2] + 1 and text[tokens[i][2]] == " ":
            yield i


def surroundings(text: str) -> list[tuple[int, bool, int, list[str], list[str], list[str]]]:
    """For each entity: its number, whether it is its first place in the text, a digest of the words around it, and the
    terms around it: those that the text has had around no entity, around others only, and around this one already."""
    spans = base_spans(text)
    if not spans:
        return []
    blank = _without(text, spans)
    tokens = _tokens(blank)
    starts, paired = [a for _, a, _ in tokens], set(_pairs(blank, tokens))
    entities, met, ever, out = set(), set(), set(), []
    for kind, a, b in spans:
        entity = _entity(kind, text[a:b])
        low, high = max(0, bisect_left(starts, a) - REACH), bisect_left(starts, b) + REACH
        words = [t for t, _, _ in tokens[low:high]]
        terms = set(words) | {f"{words[k]} {words[k + 1]}" for k in range(len(words) - 1) if low + k in paired}
        fresh = {t for t in terms if (entity, t) not in met}
        around = xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)
        out.append((entity, entity not in entities, around, sorted(terms - ever), sorted(fresh & ever), sorted(terms - fresh)))
        entities.add(entity)
        ever |= terms
        met.update((entity, t) for t in fresh)
    return out


class Filter:
    """A Bloom filter of fixed size; terms that it does not hold rarely pass until it is crowded."""

    def __init__(self, words: dict[int, int]):
        self.bits = bytearray(FILTER_BITS // 8)
        for at, word in words.items():
            self.bits[8 * at : 8 * at + 8] = (word & (1 << 64) - 1).to_bytes(8, "little")
        self.known: dict[str, int] = {}
        self.clear: set[bytes] = set()

    @staticmethod
    def of(terms: DataFrame) -> "Filter":
        """The filter of a table's ``term`` column, and, behind a mark, of all words in it."""
        words = terms.select(F.explode(F.split("term", " ")).alias("term"))
        every = terms.select("term").unionByName(words.select(F.concat(F.lit(PART), "term").alias("term")))
        h = F.xxhash64("term")
        places = F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in SHIFTS])
        places = every.select(F.explode(places).alias("place"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (c("place") % 64).cast("int"))
        # No more rows than the filter has words of 64 bits.
        rows = places.groupBy(F.floor(c("place") / 64).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
        return Filter({r["at"]: r["bits"] for r in rows})

    def __contains__(self, term: str | bytes) -> bool:
        h, bits = xxhash.xxh64_intdigest(term, seed=42), self.bits
        for k in SHIFTS:
            place = (h >> k) & (FILTER_BITS - 1)
            if not bits[place >> 3] >> (place & 7) & 1:
                return False
        return True

    def marks(self, word: str) -> int:
        """0 for a word of no term, 1 if it may be part of a pair, 3 if it may be a term itself."""
        if (found := self.known.get(word)) is None:
            if len(self.known) >= WORDS_KNOWN:
                self.known.clear()
            found = self.known[word] = 0 if PART + word not in self else 3 if word in self else 1
        return found

    def may_hold(self, text: str) -> bool:
        """Whether any word of a text may be held; pieces between ASCII blanks and punctuation, found clear once, stay so."""
        if len(self.clear) >= WORDS_KNOWN:
            self.clear.clear()
        found = False
        for piece in set(text.encode().translate(_PIECES).split()) - self.clear:
            if piece.isascii():
                held = _PART + piece.lower() in self
            else:
                held = any(self.marks(w.lower()) for w in _WORD.findall(piece.decode()))
            if held:
                found = True
            else:
                self.clear.add(piece)
        return found

    def candidates(self, text: str) -> list[tuple[str, int, int]]:
        """Term, start and end of all that may be held in a text."""
        if not self.may_hold(text):
            return []
        tokens = _tokens(text)
        marks = [self.marks(t) for t, _, _ in tokens]
        out = [token for token, m in zip(tokens, marks) if m == 3]
        for i in _pairs(text, tokens):
            if marks[i] and marks[i + 1] and (pair := f"{tokens[i][0]} {tokens[i + 1][0]}") in self:
                out.append((pair, tokens[i][1], tokens[i + 1][2]))
        return out


def contexts(docs: DataFrame) -> DataFrame:
    """``entity, first, around, firsts, fresh, others`` of each entity in each text, as ``surroundings`` has them."""
    lists = ("firsts", "fresh", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entity", pa.int64()), ("first", pa.bool_()), ("around", pa.int64()), *((n, pa.list_(pa.string())) for n in lists)])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                rows = surroundings(text or "")
                for i in range(0, len(rows), 10_000):
                    columns = zip(*rows[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    return docs.select("text").mapInArrow(run, ", ".join(["entity bigint, first boolean, around bigint", *(f"{n} array<string>" for n in lists)]))


def near_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entity, term, both`` of the terms seen in enough surroundings of an entity, and ``entity, held``, the documents of each."""
    small_batches(docs.sparkSession)
    seen = stage(contexts(docs), "contexts")
    marked_as = lambda name, new: F.transform(name, lambda t: F.struct(t.alias("term"), F.lit(new).alias("new")))
    every = F.concat(marked_as("firsts", 1), marked_as("fresh", 1), marked_as("others", 0))
    near = seen.select("entity", "around", F.inline(every))
    # One row for each surrounding first, so that neither a common word nor a common entity is one task's.
    near = near.groupBy("entity", "term", "around").agg(F.sum("new").alias("docs"))
    near = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("docs").alias("both"))
    # A term has at least the documents that have it around any entity, so common words need not be counted further.
    least = seen.select(F.explode("firsts").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("least"))
    near = near.filter(c("contexts") >= CONTEXTS).join(least, "term")
    near = stage(near.filter(F.log2(c("least") / c("both")) <= GENERALISE_BITS).select("entity", "term", "both"), "near-terms")
    return near, seen.groupBy("entity").agg(F.sum(c("first").cast("bigint")).alias("held"))


def scanned(docs: DataFrame, text: bool = False) -> tuple[DataFrame, DataFrame]:
    """The marked rows of all documents (see ``marked``), and the disclosing terms among what they may hold:
    ``term, removed, left, given``, the bits that a term leaves of the entity it tells most about, the part of the information
    it gives, and whether it is to be removed."""
    near, held = near_terms(docs)
    rows = stage(marked(docs, None if near.isEmpty() else Filter.of(near.select("term").distinct()), text), "marked")
    terms = F.array_distinct(F.transform("may", lambda m: m["term"]))
    counts = rows.filter(F.size("may") > 0).select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    found = near.join(counts, "term").join(held, "entity")
    information = F.log2(F.lit(float(max(1, rows.count()))) / c("held"))
    left = F.log2(c("docs") / c("both"))
    found = found.select("term", left.alias("left"), F.when(information > 0, (information - left) / information).otherwise(0.0).alias("given"))
    found = found.filter((c("left") <= GENERALISE_BITS) & (c("given") >= SHARE))
    found = found.groupBy("term").agg(F.min(F.struct("left", "given")).alias("most"))
    return rows, stage(found.select("term", (c("most.left") <= REMOVE_BITS).alias("removed"), "most.left", "most.given"), "disclosing")


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """``term, removed, left, given`` of the terms that give an entity away."""
    return scanned(docs.select("doc_id", "text"))[1]


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def marked(docs: DataFrame, wanted: Filter | None, text: bool = False) -> DataFrame:
    """``doc_id``, a key of the row, the counts and ``base_sha256``, ``base`` (spans), ``may`` (terms that may be disclosing), and the text if asked for."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("doc_id", kind), ("row", "string"), *((f"n_{k}", "bigint") for k in KINDS), ("base_sha256", "string")]
    fields += [("base", "array<struct<kind:int,start:int,end:int>>"), ("may", "array<struct<term:string,start:int,end:int>>")] + [("text", "string")] * text
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    may_type = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of all tries of a task one is written, and its keys hold from then on.
        task, row = uuid.uuid4().hex, 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            may = [wanted.candidates(_without(t, b)) if wanted else [] for t, b in zip(texts, base)]
            columns = [batch.column("doc_id"), pa.array([f"{task}{row + i}" for i in range(len(batch))], pa.string())]
            columns += [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(_digest(b).encode()).hexdigest() for b in base], pa.string()))
            columns.append(pa.array([[dict(zip(("kind", "start", "end"), s)) for s in b] for b in base], base_type))
            columns.append(pa.array([[dict(zip(("term", "start", "end"), s)) for s in m] for m in may], may_type))
            row += len(batch)
            yield pa.RecordBatch.from_arrays(columns + [batch.column("text")] * text, names=[n for n, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))


def _union(terms: list[tuple[int, int, bool]]) -> list[tuple[str, int, int]]:
    """Overlapping spans as one, which is removed if one of them is; removed ones first."""
    out: list[list] = []
    for start, end, removed in sorted(terms):
        if out and start < out[-1][1]:
            out[-1] = [out[-1][0], max(end, out[-1][1]), removed or out[-1][2]]
        else:
            out.append([start, end, removed])
    return sorted(((REMOVED if r else GENERALISED, a, b) for a, b, r in out), key=lambda s: (s[0] != REMOVED, s[1]))


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with personal data as the names of their kinds, generalised terms as the kind of word, and without the removed."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        value = text[a:b]
        general = "[NUMBER]" if value.isdigit() else "[NAME]" if value[:1].isupper() else "[WORD]"
        # Of what overlaps the first span stands for both.
        parts += [text[at : max(a, at)], "" if a < at or kind == REMOVED else general if kind == GENERALISED else f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, text: bool = True) -> DataFrame:
    """``doc_id``, how many spans of each base kind, ``base_sha256``, ``spans`` (``kind:start:end``, joined) and, if asked for, the sanitised ``text``.

    Positions are code points, ends exclusive. A null text is empty and has no spans. Rows that repeat are treated each,
    and each counts as a document; texts are taken whole, however long, in time linear in their length. Ties cannot matter:
    a term has the one outcome everywhere. Extra columns are left out; an empty table gives an empty one.
    """
    rows, terms = scanned(docs.select("doc_id", "text"), text)
    found = rows.filter(F.size("may") > 0).select("row", F.inline("may")).join(terms.select("term", "removed"), "term")
    # No more than one text has.
    found = found.groupBy("row").agg(F.collect_list(F.struct("start", "end", "removed")).alias("terms"))
    rows = rows.drop("may").join(found, "row", "left")
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [[(KINDS[s["kind"]], s["start"], s["end"]) for s in b] for b in batch.column("base").to_pylist()]
            more = [_union([(s["start"], s["end"], s["removed"]) for s in t or []]) for t in batch.column("terms").to_pylist()]
            spans = [b + m for b, m in zip(base, more)]
            columns = [batch.column(n) for n in names] + [pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in spans], pa.string())]
            if text:
                columns.append(pa.array([sanitised(t.as_py() or "", s) for t, s in zip(batch.column("text"), spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["spans"] + ["text"] * text)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names]
    order = sorted(kinds, key=lambda k: names.index(k.split()[0]))
    return rows.mapInArrow(run, ", ".join([*order, "spans string"] + ["text string"] * text))
