"""HTML extraction by the maximum-scoring subsequence of words and tags.

A page is read as a row of tags and runs of words. Words score by where they stand, positive in running text, and tags
score negative, the more so the seldomer they are found within articles; the weights are log-odds counted on pages that
mark their article. One linear scan finds the contiguous run of tokens with the largest sum, the content region. Parts
in it that are no running text (menus, adverts, forms, comments and the like) are left out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.llm.common import small_batches, some_of
from rollkeeper.llm.neardup import _steps, _texts

c = F.col

# About so many pages, those with low hashes of their ids, are looked at for articles that the weights are counted on.
SAMPLE = 5_000
STRONGEST = 6.0
# Scores of kinds that no labelled page has.
UNSEEN_WORD = 1.0
UNSEEN_TAG = -0.25
# Score of a word or tag in a part that is left out.
LEFT_OUT = -1.0

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
# What follows a tag's name: quotes open a value only after an equals sign, and only if they close again.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
NAMED = frozenset(("class", "id", "role"))
# Elements of HTML, by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset head address".split())
ARTICLE = frozenset(("article", "main"))
# Elements whose content is no text of the page; it ends at their end tag whatever is in it.
RAW = frozenset("script style noscript template iframe svg textarea title select object canvas".split())
BLOCKS = frozenset(
    "body blockquote caption center col colgroup dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup html legend li ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul video audio picture math".split()
)
CLOSED_BY_NEXT = frozenset(("p", "li", "dt", "dd"))
# Elements that are also put around whole pages; they and named parts stay where they hold the content.
AROUND = frozenset(("form", "fieldset"))
# Names in class, id or role of parts which are no running text. A name counts only as a whole, such as ``ad``, ``cookie-banner``
# or ``comment-list``: all pieces are names or words for a part. Names of layouts, such as ``has-sidebar``, say nothing.
_NAMES = (
    r"(?:ads?|advert[^\W_]*|adsense|sponsor[^\W_]*|promo[^\W_]*|banner|nav[^\W_]*|menu[^\W_]*|breadcrumbs?|side-?bar|widget|footer|masthead|site-?header"
    r"|page-?header|comments?|discussion|disqus|repl(?:y|ies)|notices?|cookie[^\W_]*|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe"
    r"|subscription|signup|sign-?in|login|share|sharing|social|related|recommend[^\W_]*|pagination|pager|toolbar|search|form|complementary|contentinfo"
    r"|dialog|skip-?link|hidden)"
)
_PARTS = r"(?:area|bar|block|box|buttons?|container|items?|links?|lists?|posts|section|slot|unit|wrap|wrapper|[0-9]+)"
_OTHER = re.compile(rf"(?:{_PARTS}[_-]+)*{_NAMES}(?:[_-]+(?:{_NAMES}|{_PARTS}))*", re.IGNORECASE)

Token = tuple[str, str, bool, bool]
KNOWN = VOID | INLINE | ASIDE | ARTICLE | RAW | BLOCKS


class Tag(NamedTuple):
    """A tag, or something that is no text (with an empty name): comments, declarations and elements left out whole."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""

    @property
    def empty(self) -> bool:
        return self.name in VOID or self.attributes.rstrip().endswith("/")


def tags(page: str) -> Iterator[Tag]:
    """What is no text, in page order, in time linear in the page.

    A ``<`` before anything but a name, ``/``, ``!`` or ``?`` is text, and so is one that no ``>`` follows. Should a tag not end as
    its quotes are read, it and those after it end at the next ``>``.
    """
    at, last, by_quotes = page.find("<"), page.rfind(">"), True
    while 0 <= at < last:
        end = -1
        name = _NAME.match(page, at + 1)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield Tag(at, end)
        elif name:
            rest = _REST.match(page, name.end()) if by_quotes else None
            by_quotes = rest is not None
            stop = rest.end() - 1 if rest else page.find(">", name.end())
            end = stop + 1
            called, closing = name[0].lstrip("/").lower(), name[0][0] == "/"
            if called in RAW and not closing:
                # The end tag, or the end of the page.
                close = _raw_end(called).search(page, end)
                end = close.end() if close else len(page)
                yield Tag(at, end)
            else:
                yield Tag(at, end, called, closing, page[name.end() : stop])
        elif page[at + 1] in "!?/":
            end = page.find(">", at) + 1
            yield Tag(at, end)
        at = page.find("<", end if end > 0 else at + 1)


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.IGNORECASE)


class Open:
    """The open elements of a page."""

    def __init__(self) -> None:
        # Each with the innermost one that is not inline.
        self.stack: list[tuple[str, str]] = []
        self.names: Counter[str] = Counter()

    @property
    def around(self) -> str:
        return self.stack[-1][1] if self.stack else ""

    def begin(self, name: str) -> None:
        self.stack.append((name, self.around if name in INLINE else name))
        self.names[name] += 1

    def close(self, name: str) -> None:
        """Close the innermost element of a name and all in it; nothing if there is none."""
        while self.names[name]:
            closed = self.stack.pop()[0]
            self.names[closed] -= 1
            if closed == name:
                return


def tokens(page: str) -> Iterator[Token]:
    """Tags and runs of text in page order: kind (``/name`` for an end), text, whether within another part, whether in an article.

    The kind of a run of text is the element that it stands in, or, after a mark, the part that it lies in.
    """
    held = Open()
    part, depth, article = "", 0, 0
    at = 0
    found = list(tags(page))
    content = _content(page, found)
    for k, tag in enumerate(found):
        if tag.start > at:
            yield f"#{'!' + part if part else held.around}", page[at : tag.start], bool(part), article > 0
        at = tag.end
        name, closing = tag.name, tag.closing
        if not name:
            continue
        # An unclosed paragraph or item ends where the next block begins.
        if part in CLOSED_BY_NEXT and name not in INLINE and not (closing and name == part):
            part, depth = "", 0
        elif part and name == part:
            depth += -1 if closing else 1
        opened = not closing and not tag.empty
        if opened and not part and (name in ASIDE and not (name == "header" and article) or _other(name, tag.attributes)):
            if k not in content:
                part, depth = name, 1
        yield ("/" if closing else "") + name, "", bool(part), article > 0
        if part and depth <= 0:
            part = ""
        if opened:
            article += name in ARTICLE
            held.begin(name)
        elif closing:
            article -= name in ARTICLE and article > 0
            held.close(name)
    if at < len(page):
        yield f"#{'!' + part if part else held.around}", page[at:], bool(part), article > 0


def _other(name: str, attributes: str) -> bool:
    if name in ARTICLE or name in ("body", "html"):
        return False
    values = (a or b or d for called, a, b, d in _ATTRIBUTE.findall(attributes) if called.lower() in NAMED)
    return any(_OTHER.fullmatch(x) for value in values for x in value.split())


def _content(page: str, found: list[Tag]) -> set[int]:
    """Places of the tags of named parts and forms that hold the content: the longest article or main, or else most of its words.

    Without articles, the words are those in paragraphs, or all of them if no paragraph has any. The longest one is asked for
    as comments and related pages are often articles too.
    """
    asked, articles = [], []
    # Words and words in paragraphs up to each tag, open elements of each name, and where they end.
    words, ends, begun = [(0, 0)], {}, {}
    open_ones = Open()
    total = inside = at = 0
    for k, tag in enumerate(found):
        n = len(page[at : tag.start].split())
        total, at = total + n, tag.end
        inside += n if n and open_ones.around == "p" else 0
        words.append((total, inside))
        name = tag.name
        if not name or name in VOID or not tag.closing and tag.empty:
            continue
        if tag.closing:
            if begun.get(name):
                ends[begun[name].pop()] = k
            open_ones.close(name)
            continue
        open_ones.begin(name)
        begun.setdefault(name, []).append(k)
        if name in ARTICLE:
            articles.append(k)
        elif name in AROUND or _other(name, tag.attributes):
            asked.append(k)
    if not asked:
        return set()
    n = len(page[at:].split())
    words.append((total + n, inside + (n if n and open_ones.around == "p" else 0)))
    last = len(found)
    held = lambda k, which: words[ends.get(k, last) + 1][which] - words[k + 1][which]
    if articles:
        longest = max(articles, key=lambda k: (held(k, 0), -k))
        return {k for k in asked if k < longest and ends.get(k, last) > longest}
    which = 1 if words[-1][1] else 0
    return {k for k in asked if 2 * held(k, which) > words[-1][which]}


def kind_of(kind: str) -> str:
    """The kind that weights are kept for: elements that HTML does not know are one."""
    name = kind.lstrip("#!/")
    return kind if not name or name in KNOWN else kind[: len(kind) - len(name)] + "other"


def count_kinds(page: str) -> Counter:
    """Tags and words inside and outside of the article of a labelled page, by kind; nothing of pages without one.

    Parts that are left out anyhow say nothing on the tags in them.
    """
    seen = [
        (kind, len(text.split()) if kind[0] == "#" else 1, inside)
        for kind, text, other, inside in tokens(page)
        if not other and (text.strip() or kind[0] != "#")
    ]
    if not any(inside for _, _, inside in seen):
        return Counter()
    out: Counter = Counter()
    for kind, n, inside in seen:
        out[kind_of(kind), inside] += n
    return out


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of standing in an article; below zero for every tag."""
    out = {}
    for kind in {k for k, _ in counts}:
        odds = math.log((counts.get((kind, True), 0) + 0.5) / (counts.get((kind, False), 0) + 0.5))
        out[kind] = max(-STRONGEST, min(odds, STRONGEST if kind[0] == "#" else -0.05))
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the run with the largest sum, the first and shortest of equals; empty if none is above zero."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def main_text(page: str, weight: dict[str, float]) -> str:
    """Text blocks of the content region, one a line."""
    row = list(tokens(page))
    scores = []
    for kind, text, other, inside in row:
        if other:
            # What is left out of a marked article does not break it.
            scores.append(0.0 if inside else LEFT_OUT * max(1, len(text.split())))
        elif kind[0] == "#":
            scores.append(weight.get(kind_of(kind), UNSEEN_WORD) * len(text.split()))
        else:
            scores.append(weight.get(kind_of(kind), UNSEEN_TAG))
    begin, end = region(scores)
    blocks, now = [], []
    for kind, text, other, _ in row[begin:end]:
        if kind[0] == "#":
            if not other:
                now.append(text)
        elif kind.lstrip("/") == "br":
            now.append(" ")
        elif kind.lstrip("/") not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    lines = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def page_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from labelled pages among about ``sample`` pages."""
    small_batches(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for text in _texts(batch.column("html")):
                total += count_kinds((text or b"").decode())
            kinds = list(total)
            columns = [pa.array([k for k, _ in kinds], pa.string()), pa.array([i for _, i in kinds], pa.bool_()), pa.array([total[k] for k in kinds], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "inside", "n"])

    some = some_of(pages, sample, "page_id").filter(c("html").rlike("(?i)<(article|main)\\b"))
    table = some.select("html").mapInArrow(count, "kind string, inside boolean, n bigint").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    # A few rows for each element that HTML knows.
    return weights({(r.kind, r.inside): r.n for r in table.collect()})


def extracted(pages: DataFrame, weight: dict[str, float] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null, empty or tagless html has an empty text, or its plain words; pages of any length are read whole, in time linear in it. Rows that repeat are read each; extra columns are
    left out; an empty table gives an empty one. Weights are counted on the pages themselves unless given.
    """
    small_batches(pages.sparkSession)
    weight = page_weights(pages, sample) if weight is None else weight
    carried = ["page_id", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _texts(batch.column("html"))
            for a, b in _steps([len(t or b"") for t in raw]):
                texts = [main_text((t or b"").decode(), weight) for t in raw[a:b]]
                rows = batch.slice(a, b - a).select(carried)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carried, "text", "n_chars"]
                )

    kinds = ", ".join(f"{n} {pages.schema[n].dataType.simpleString()}" for n in carried)
    return pages.select(*carried, "html").mapInArrow(run, f"{kinds}, text string, n_chars bigint")
