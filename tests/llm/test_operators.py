"""Each operator on small tables, against a brute-force version, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollkeeper.llm import linededup, mixing, neardup, neighbours, pages, pieces, quality, queries, secrets, shingles, suffixes, toxicity
from rollkeeper.llm.oracle import ORACLES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["kept", "row", "n_words", "size", "id", "key", "_id", "node", "place", "drops", "score", "ids"]
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = words(400)
    near = base[:200] + ["changed"] + base[201:]
    return [
        (1, " ".join(base), "en", "a", 1),
        (2, " ".join(base), "en", "a", 1),
        (3, " ".join(near), "en", "b", 1),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \n\t ", "en", "c", 4),
        (7, "one two", "de", "c", 7),
        (8, "ONE two", "de", None, 7),
        (9, "the same long line of text\nother " + " ".join(words(60, 1)), "fr", "b", 9),
        (10, " The SAME long line of text\t\n" + " ".join(words(60, 2)), "fr", "b", 9),
        (11, "the same long line of text\nthe same long line of text\n" + " ".join(words(60, 3)), "fr", "b", 9),
        (7, "one two", "de", "c", 7),
        (12, "Ünï çodé ✓ 日本 " * 200, "es", "b", 9),
        (None, " ".join(words(70, 4)), "es", "b", 9),
        (13, " ".join(words(30_000, 5)), "es", "a", 9),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    table = spark.createDataFrame(texts, DOCS)
    return table.withColumns({n: F.lit(f"x{n}") for n in CLASHING})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, queries.QUERIES[name], ORACLES[name], FOLDER) == ""


# --- quality -------------------------------------------------------------------------------------


def test_counts_equal_brute_force(docs, texts):
    got = rows_of(quality.counts(docs.select("doc_id", "text")).select("_q.*"))
    expected = []
    for _, text, *_ in texts:
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)))
    assert sorted(got) == sorted(expected)


def test_binomial_tail_and_cutoffs(spark):
    for n, k, p in ((50, 0, 0.02), (400, 3, 0.004), (3000, 5, 0.004)):
        got = spark.range(1).select(quality.log_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        assert math.isclose(math.exp(got), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
    good = [("en", 1, 100, 500, 0, 0, 0)] * 4000 + [("en", 1, 100, 500, 90, 0, 0)] * 2 + [("xx", 1, 100, 500, 0, 0, 0)] * 5
    table = spark.createDataFrame(good, "stratum string, quality int, " + ", ".join(f"{n} long" for n in quality.COUNTS))
    chosen = {r.stratum: r for r in quality.cutoffs(table).collect()}
    assert chosen["en"].symbols_per_word == 0.02  # 2 of 4002 is well below the limit
    assert chosen["xx"].symbols_per_word is None  # five labels prove nothing


def test_quality_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (7, 1), (7, 0), (99, 1)], "doc_id long, quality int")
    rows = quality.judged(docs, labels)
    assert rows.count() == 15 and quality.judged(none, labels.limit(0)).count() == 0
    assert {r.doc_id for r in rows.filter("base_failed").select("_row.doc_id").collect()} >= {4, 5, 6, 7, 8}
    kept = quality.kept_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3}


def test_strata_stand_for_themselves(spark, monkeypatch):
    """Labels of null and of other languages say nothing on a language without labels, or with few, however many there are."""
    text = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop")
    long = " ".join(f"{a * 20}{b * 20}" for a in "abcdefgh" for b in "ijklmnop")
    good = [(i, text, None) for i in range(3500)] + [(10_000 + i, text, f"l{i % 220:03d}") for i in range(440)]
    asked = [(20_000, long, None), (20_001, long, "zz"), (20_002, long, "l219"), (20_003, long, "l000"), (20_004, text, None)]
    table = spark.createDataFrame(good + asked, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in good], "doc_id long, quality int")
    for sent in (10_000, 0):  # the way for many strata
        monkeypatch.setattr(quality, "SENT_ROWS", sent, raising=False)
        rows = quality.judged(table, labels, carried=("doc_id",)).filter("_row.doc_id >= 20000")
        got = {r.doc_id: r.kept for r in rows.select("_row.doc_id", "kept").collect()}
        assert got == {20_000: False, 20_001: True, 20_002: True, 20_003: True, 20_004: True}


def quality_table(spark, folder):
    """Documents and labels on which every rule finds a cutoff in two strata, one of them null, and too few labels in a third."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda n: "".join(rng.choice(letters, n))
    plain = [" ".join(word(int(n)) for n in rng.integers(4, 8, 60)) for _ in range(40)]
    line = " ".join(word(5) for _ in range(3))
    odd = [
        plain[0] + " #" * 200, plain[1] + f"\n{line}" * 40, plain[2] + f" {line}" * 12, " ".join(word(40) for _ in range(60)),
        " ".join(rng.choice(letters) for _ in range(90)), plain[3] + " # $", plain[4] + f" {line} {line}",
    ]
    docs, labels = [], []
    for lang, n in (("en", 2600), (None, 2600), ("xx", 300)):
        for i in range(n):
            doc = len(docs)
            # A few odd ones are good, fewer than the limit.
            bad = i % 20 == 0
            docs.append((doc, (odd[i // 20 % len(odd)] if bad else plain[i % len(plain)]) + f" {word(5)}", lang, "s", 1))
            labels.append((doc, int(not bad or i in (0, 60)), 0))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_chosen_cutoffs_equal_sql(spark, tmp_path):
    import duckdb

    quality_table(spark, tmp_path)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(spark, con, "op3", queries.op3_quality_rules, ORACLES["op3_quality_rules"], str(tmp_path)) == ""
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = quality.judged(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    lost = Counter(r.lang for r in rows.filter("not kept and not base_failed").select("_row.lang").collect())
    assert lost["en"] > 50 and lost[None] > 50 and lost["xx"] == 0
    seen = quality.counts(docs).select("doc_id", F.col("lang").alias("stratum"), "_q.*").join(spark.read.parquet(f"{tmp_path}/labels.parquet"), "doc_id")
    chosen = {r.stratum: r for r in quality.cutoffs(seen).collect()}
    for rule in quality.GRIDS:
        assert chosen["en"][rule] is not None and chosen[None][rule] is not None and chosen["xx"][rule] is None, rule


def test_cutoffs_stop_at_the_first_failure(spark):
    """A cutoff that passes again after one that failed cannot be reached; counts never fall as cutoffs do."""
    good = [("en", 1, 100, 500, 0, 0, 0)] * 4000 + [("en", 1, 100, 500, 120, 0, 0)] * 60
    table = spark.createDataFrame(good, "stratum string, quality int, " + ", ".join(f"{n} long" for n in quality.COUNTS))
    assert quality.cutoffs(table).first().symbols_per_word == 1.5


# --- lines -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_lines_equal_brute_force(docs, texts, batches):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for i, (d, text, *_) in enumerate(texts):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(d)
    expected = []
    for d, text, *_ in texts:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held[key(x)]) < 3 or d == max(y for y in held[key(x)] if y is not None)]
        expected.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    rows = linededup.dedup_lines(docs, batches=batches).select("row.doc_id", "n_lines", "n_dropped", F.coalesce("row.text", F.lit("")))
    assert sorted(rows_of(rows), key=repr) == sorted(expected, key=repr)


def test_runs_follow_the_size():
    assert linededup.layout(0) == (4, 16) and linededup.layout(10 << 30) == (4, 16)
    assert linededup.layout(100 << 40) == (25, 100 << 10)


def test_runs_leave_nothing_in_the_catalogue(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    assert linededup.dedup_lines(docs).count() == 15
    assert {t.name for t in spark.catalog.listTables()} == before


def test_lines_of_nothing(none):
    assert linededup.dedup_lines(none).count() == 0


def test_runs_are_compacted(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for ids in ([9, 8], [7, 6], [5, 4], [3]):
        rows = [(bytes([k % 3]), k) for k in ids] + [(b"all", k) for k in ids]
        runs.add(spark.createDataFrame(rows, "hash binary, doc_id long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {(bytes(r.hash), r.docs, r.keeper) for r in runs.totals().collect()} == {(b"all", 7, 9), (b"\0", 3, 9), (b"\1", 2, 7), (b"\2", 2, 8)}


# --- near duplicates -----------------------------------------------------------------------------------


def brute_components(items):
    """Smallest id reachable of each (id, text), and the size of its set."""
    sets = [shingle_set(t) for _, t in items]
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(items):
        r = find(i)
        known = lowest.get(r)
        lowest[r] = d if known is None else known if d is None else min(known, d)
    return [(d, len(s), lowest[find(i)], d == lowest[find(i)]) for i, ((d, _), s) in enumerate(zip(items, sets))]


def edited(base, share, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"{w}{seed}" if rng.random() < share else w for w in base)


def test_components_equal_brute_force(spark, docs, texts):
    got = neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(rows_of(got), key=repr) == sorted(brute_components([t[:2] for t in texts]), key=repr)
    # A family of copies, edited from lightly to beyond the limit.
    base = words(120, 9)
    items = [(i, edited(base, 0.002 * (i % 40), i)) for i in range(150)]
    table = spark.createDataFrame([(*x, None, None, None) for x in items], DOCS)
    got = neardup.near_duplicates(table).select("doc_id", "n_shingles", "component_id", "kept")
    expected = brute_components(items)
    assert sorted(rows_of(got)) == sorted(expected)
    assert len({x[2] for x in expected}) > 5


def test_few_links_need_no_rounds(spark, monkeypatch):
    names, stage = [], neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda df, name: (names.append(name), stage(df, name))[1])
    # Two paths whose nodes come in no order, dealt over several tasks.
    order = np.random.default_rng(2).permutation(400)
    node = [b"%03d" % i for i in order]
    pairs = [(bytearray(node[i]), bytearray(node[i + 1])) for i in range(399) if i != 250]
    links = spark.createDataFrame(pairs, "a binary, b binary").repartition(6)
    expected = {n: min(node[:251]) if i <= 250 else min(node[251:]) for i, n in enumerate(node)}
    few = {bytes(r.node): bytes(r.root) for r in neardup.components(links).collect()}
    assert few == expected and "nearer" not in names
    monkeypatch.setattr(neardup, "LINKS_AT_ONCE", 100, raising=False)
    many = {bytes(r.node): bytes(r.root) for r in neardup.components(links).collect()}
    assert many == expected and "nearer" in names


def test_kept_documents(docs, none):
    kept = neardup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 4, 5, 6, 7, 9, 10, 11, 12, 13, None], key=repr)
    assert neardup.near_duplicates(none).count() == 0


def test_signatures_estimate_similarity():
    base = words(600, 3)
    a, b = " ".join(base).encode(), " ".join(base[:500] + words(100, 8)).encode()
    values, begins = shingles.shingle_sets([a, b, b"", None, b"x"])
    sig = shingles.super_minhash(values, begins)
    x, y = values[begins[0] : begins[1]], values[begins[1] : begins[2]]
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15
    # Every place of a set has the rank of a round, and each element visits each place once.
    assert ((sig[4] >> np.uint64(57)) < 128).all() and len(set((sig[4] >> np.uint64(57)).tolist())) == 128


# --- repeated bytes ----------------------------------------------------------------------------------------


def brute_repeats(items, size=400):
    seen = defaultdict(list)
    for d, t in enumerate(items):
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]].append((d, i))
    gone = [np.zeros(len(t), dtype=bool) for t in items]
    for places in seen.values():
        for d, i in places if len(places) > 1 else []:
            gone[d][i : i + size] = True
    out = []
    for t, g in zip(items, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((len(t), int(g.sum()), int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("collection", [4096, 3])
def test_repeats_equal_brute_force(spark, texts, monkeypatch, collection):
    """Also with collections so small that they are split."""
    monkeypatch.setattr(suffixes, "COLLECTION", collection)
    passage = " ".join(words(120, 20))
    items = [t[1] for t in texts if t[0] != 13]
    items += [f"{i} {' '.join(words(20, i))} {passage[i % 5 :]} {' '.join(words(30, 50 + i))}" for i in range(12)]
    items += ["ab" * 500, "ab" * 199, passage[:399], passage[:400], "é" * 300, passage + " " + passage]
    table = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(items)], "doc_id long, text string").withColumn("kept", F.lit(1))
    got = suffixes.without_repeats(table).select("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(rows_of(got)) == sorted(brute_repeats([(t or "").encode() for t in items]))
    assert suffixes.without_repeats(table.limit(0)).count() == 0


# --- tokens ---------------------------------------------------------------------------------------------------


def test_tokens_equal_the_library(docs, texts, none):
    model = pieces.model_bytes(docs.sparkSession, pieces.model_path())
    coder = pieces.Pieces(model, whole_texts=10**9)  # raises where the library differs
    odd = ["", " ", "  a  b ", "\n\n", "▁x", "a" * 3000, "🎉 <s> <0x0A>", "1234567890 " * 9, None, *(t[1] for t in texts)]
    assert coder.decode(coder.encode(odd)) == coder.library.decode([r.tolist() for r in coder.encode(odd)])
    got = {r.doc_id: r for r in pieces.encoded(docs, model).collect()}
    for d, text, *_ in texts:
        ids = coder.library.encode(text or "", add_bos=True, add_eos=True)
        assert got[d].ids == ids and got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(coder.library.decode(ids).encode()).hexdigest()
    back = pieces.decoded(pieces.encoded(docs, model).select("doc_id", "ids"), model)
    assert {r.doc_id: r.text for r in back.collect()} == {d: t or "" for d, t, *_ in texts}
    assert pieces.encoded(none, model).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------


def test_mix(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 15 and all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mix_meets_targets(spark, monkeypatch):
    table = spark.range(6000).select(
        c_id := F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 9 == 0, "tiny").otherwise(F.lit(None)).alias("source"),
    )
    assert c_id is not None
    first = {r.doc_id: r for r in mixing.mix(table).collect()}
    monkeypatch.setattr(mixing, "SENT_ROWS", 0)  # the way for many sources
    assert {r.doc_id: r for r in mixing.mix(table).collect()} == first
    taken, target = Counter(), {}
    for r in first.values():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 6 for s in target)
    assert math.isclose(sum(target.values()), 1.5 * sum(r["size"] for r in first.values()))
    copies = Counter(r.doc_id for r in mixing.mixed_documents(table).select("doc_id").collect())
    assert all(copies[d] == r.times for d, r in first.items())


# --- pages -----------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    page = (
        "<html><head><title>No</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp;  b</h1>"
        "<script>var t='</p>';</script><p>Some <b>bold</b>\n words<p class='notice'>We use cookies<p>here<br>and &lt;p&gt; there</p>"
        "<div class='ad'>Buy <p>now</p></div><form>Name</form><ul><li>One</li></ul></article><div id=comments><p>I like it a lot, friends</p></div>"
        "<footer>&copy; me</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "plain &amp; words"), (1, "u", page), (5, "x", "<p>unclosed <b"), (6, "y", page * 200)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in pages.extracted(table).collect()}
    assert got[1].text == "A & b\nSome bold words\nhere and <p> there\nOne" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text == "plain & words"
    assert pages.extracted(table).count() == 7 and pages.extracted(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    "name", ["content has-sidebar", "page no-comments", "nav-open main", "with-ads", "search-results", "related", "form-wrapper", "search"]
)
def test_wrappers_named_by_layout_stay(name):
    """Names of layouts, and names and forms around the content, leave nothing out; parts in and beside them still go."""
    text, ad = " ".join(words(80, 60)), "<div class='ad-slot-1'>Buy now</div><div class='cookie-banner'><p>We use them</p></div>"
    comments = "<div id='comments'><ol class='comment-list'><li><article><p>I like it</p></article></ol></div>"
    more = " ".join(words(30, 61))
    inner = f"<h1>Title</h1><p>{text}</p>{ad}<p>{more}</p>"
    expected = f"Title\n{text}\n{more}"
    for article in (f"<article>{inner}</article>{comments}", f"<main>{inner}</main>", inner):
        for wrapped in (f"<div class='{name}'>{article}</div>", f"<form id=all><fieldset>{article}</fieldset></form>"):
            page = f"<html><body><nav><a href='/'>Home</a></nav>{wrapped}<div class=sidebar><p>Other pages</p></div></body></html>"
            assert pages.main_text(page, {}) == expected, page
    posts = "".join(f"<div class='post no-comments'><p>{' '.join(words(20, i))}</p></div>" for i in range(5))
    assert len(pages.main_text(posts, {}).split()) == 100


def test_pages_give_their_articles(spark):
    """Every page of the given table, against its marked article."""
    table = spark.read.parquet(f"{FOLDER}/pages.parquet")
    import html

    def article(page):
        inner = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        return "\n".join(b for b in blocks if b)

    expected = {r.page_id: article(r.html) for r in table.collect()}
    assert {r.page_id: r.text for r in queries.op1_html_extraction(spark, FOLDER).collect()} == expected


def test_apostrophes_lose_nothing():
    page = "<article><p title=don't>Hello there all</p><p>second it's line</p><p class=a\"b id='x>y' data-x = \"1 > 0\">third</p></article>"
    assert pages.main_text(page, {}) == "Hello there all\nsecond it's line\nthird"
    assert pages.main_text("<p>a < b and c <3 d</p><p>e", {}) == "a < b and c <3 d\ne"
    # Quotes that never close, and tags that never end.
    assert pages.main_text('<p title="x>one two three</p><p>four</p>', {}) == "one two three\nfour"
    assert pages.main_text("<p>one two three <b", {}) == "one two three <b"


def test_tags_equal_the_parser_of_the_standard_library():
    """Random mark-up, of which both sides give the same tags and text."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.seen = []

        def handle_starttag(self, tag, attrs):
            self.seen.append(tag)

        def handle_startendtag(self, tag, attrs):
            self.seen.append(tag)

        def handle_endtag(self, tag):
            self.seen.append("/" + tag)

        def handle_data(self, data):
            self.seen.append("#" + data)

    rng = np.random.default_rng(4)
    pieces_of = ["<p>", "</p>", "<B>", "</b >", "<br/>", "<i x=don't>", "<a href='it\"s > x'>", '<a title="a > \'b">', "<li\nclass=a id = \"b c\" >", "<!-- <p> it's -->",
                 "<!doctype html>", "text ", "it's \"quoted\" ", "a < b ", "1 <2 ", "x=y ", "<q cite=a/b>", "<em data-x>", "é "]
    for _ in range(500):
        page = "".join(rng.choice(pieces_of, 30)) + "<p>"
        parser = Parser()
        parser.feed(page)
        parser.close()
        at, mine = 0, []
        for tag in pages.tags(page):
            mine.append("#" + page[at : tag.start])
            mine.append(("/" if tag.closing else "") + tag.name)
            at = tag.end
        glue = lambda row: "|".join(("" if x[0] == "#" else "<") + x.lstrip("#") for x in row if x not in ("", "#")).replace("|", "")
        assert glue(mine) == glue(parser.seen), page


@pytest.mark.parametrize("piece", ["<b>x ", "<a ", "'", '"', "<", "</", "<!--", "<p class=\"ad", "<a x=\">\" ", "</i><b>", "<script>", "<div class='ad'>", "&amp;", "<a href='", "<p>x</i>", "id=\"", "<p =" ])
def test_long_pages_take_linear_time(piece):
    import time

    for page in (piece * (1_000_000 // len(piece)), "<article><p>word" + piece * (1_000_000 // len(piece)) + "></article>"):
        began = time.time()
        pages.main_text(page, {})
        assert time.time() - began < 10, piece


def test_best_run_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.normal(0, 1, 12).tolist()
        a, b = pages.region(scores)
        assert math.isclose(sum(scores[a:b]), max(0, max(sum(scores[i:j]) for i in range(12) for j in range(i, 13))), abs_tol=1e-9)


# --- toxicity -----------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(0)
    vocabulary = words(300, 30)
    rows, marks = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 120))
        if i % 5 == 0:
            for k in range(5):
                w.insert(int(rng.integers(0, 100)), ["nastyword", "horribleterm", "vileexpression"][k % 3])
        rows.append((i, " ".join(w), None, None, None))
        marks.append((i, int(i % 5 == 0)))
    labels = spark.createDataFrame([*marks, (1, None), (2, 5), (3, 1), (9999, 1)], "doc_id long, toxic int")
    table = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in toxicity.scored(table, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    right = [r.predicted == int(d % 5 == 0) for d, r in got.items() if r.held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.95
    scores = toxicity.scored(docs, labels.limit(0)).collect()
    assert len(scores) == 15 and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.scored(none, labels).count() == 0


# --- neighbours --------------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (3000, 16))
    good[100:400] = good[100]
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [1.0] * 3), (None, [1.0] * 16), (20, rows[20][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        scores = good @ good[q]
        order = [i for i in np.lexsort((np.arange(3000), -scores.round(9))) if i != q][:20]
        hits += len({v for v, _ in found} & set(map(int, order)))
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, scores[v], rel_tol=1e-9) for v, s in found)
    assert hits / (20 * len(got)) >= 0.9
    few = rows_of(neighbours.nearest(table.filter("vec_id in (20, 21, 22)")))
    assert [(q, r) for q, r, *_ in sorted(few)] == [(20, 1), (20, 2)]
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_copies_use_up_nothing_of_the_walk(spark):
    """A third of the rows has one vector; queries outside of that group lose no neighbours to it."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (3000, 32))
    vectors[rng.permutation(3000)[:1000]] = vectors[7]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    alone = ~(vectors == vectors[7]).all(axis=1)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, 3000, 20)) and all(len(x) == 20 for x in got.values())
    recall = {True: [], False: []}
    for q, found in got.items():
        scores = (vectors @ vectors[q]).round(9)
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:20]
        recall[bool(alone[q])].append(len(set(found) & set(map(int, order))) / 20)
    print("recall outside and inside", np.mean(recall[True]), np.mean(recall[False]))
    assert np.mean(recall[True]) >= 0.9 and recall[False] and min(recall[False]) == 1


def test_lists_hold_every_cell():
    rng = np.random.default_rng(6)
    held = rng.integers(0, 40, (9, 7)) * (rng.random((9, 7)) < 0.6)
    held[3, 4] = 500
    first, parts, lists = neighbours.lists_of(held, 100)
    sizes = np.zeros(lists)
    for cell in np.ndindex(*held.shape):
        sizes[first[cell] : first[cell] + parts[cell]] += held[cell] / parts[cell]
    assert sizes.max() <= 100 and parts[3, 4] == 5 and parts.sum() == 63 + 4 and sizes.sum() == held.sum()
    # Next to the large cell lists may be filled in part; otherwise few are.
    assert lists <= held.sum() / 100 * 2 + 2


def test_queries_fetch_visited_lists_only(spark, monkeypatch):
    """With clustered vectors and a small part visited, few lists are fetched and little is lost."""
    monkeypatch.setattr(neighbours, "SHARD", 100)
    monkeypatch.setattr(neighbours, "LEAST_VISITED", 200)
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (30, 16))
    vectors = np.repeat(centres, 100, axis=0) + rng.normal(0, 0.05, (3000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    index = neighbours.MultiIndex(table, centroids=32)
    found = index.search(index.vectors.filter("vec_id % 20 = 0"), 20, visited=0.1)
    got = defaultdict(set)
    for r in found.collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, mine in got.items():
        order = [i for i in np.argsort(-(vectors @ vectors[q])) if i != q][:20]
        hits += len(mine & set(map(int, order)))
    assert len(got) == 150 and hits / 3000 >= 0.9


def test_recall_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.vec_id for r in rows])
    got = defaultdict(set)
    for r in queries.op8_nearest_neighbours(spark, folder).collect():
        got[r.query_id].add(r.vec_id)
    hits = wanted = 0
    for q, mine in got.items():
        scores = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        order = [i for i in ids[np.lexsort((ids, -scores))].tolist() if i != q][:20]
        hits, wanted = hits + len(mine & set(order)), wanted + 20
    print("recall", hits / wanted)
    assert len(got) == (ids % 20 == 0).sum() and hits / wanted >= 0.9


def test_walk_equals_sorting_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y, held = rng.normal(0, 1, 7), rng.normal(0, 1, 9), rng.integers(0, 5, (7, 9))
        sums, sizes = (x[:, None] + y[None, :]).ravel(), held.ravel()
        order = np.argsort(-sums)
        wanted = held.sum() * 0.4
        at = np.searchsorted(np.cumsum(sizes[order]), wanted)
        assert math.isclose(neighbours.walk(x, y, held, wanted), sums[order][at])


# --- secrets --------------------------------------------------------------------------------------------------------------------


def test_secrets(spark, docs, none):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        key = hashlib.sha1(str(i).encode()).hexdigest()
        plain = "".join(words(6, 1000 + i))
        rows.append((i, f"{' '.join(words(20, i))} {plain} token = \"{key}\" and {' '.join(words(5, i))} AKIA{key.upper()[:16]}", None, "s", None))
    assert rng is not None
    got = secrets.findings(spark.createDataFrame(rows, DOCS)).collect()
    text = {r[0]: r[1] for r in rows}
    value = lambda r: text[r.doc_id][r.start : r.start + r.length]
    assert all(hashlib.sha256(value(r).encode()).hexdigest() == r.value_sha256 for r in got)
    assert all(r.is_secret == any(ch.isdigit() for ch in value(r)) for r in got)
    assert sum(r.is_secret for r in got) == 400
    assert secrets.findings(none).count() == 0 and all(not r.is_secret for r in secrets.findings(docs).collect())


def secret_documents(n, seed):
    """Documents with one candidate each, whether it is a secret, and how often each kind was made."""
    import uuid

    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    hexes, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    filler = words(50, 70)
    made = []
    for i in range(n):
        kind = i % 8
        line, secret = [
            lambda: (f'api_key = "{pick(b62, 32)}"', 1),
            lambda: (f"AWS access AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)} used", 1),
            lambda: (f"password: {pick(b62, 6)}-{pick(b62, 8)}!{pick('0123456789', 3)}", 1),
            lambda: (f"commit {pick(hexes, 40)} by us", 0),
            lambda: (f"request {uuid.UUID(bytes=rng.bytes(16))} done", 0),
            lambda: (f"the file with checksum {pick(hexes, 64)}", 0),
            lambda: (f"<img src=data:image/png;base64,{pick(b62, 60)}", 0),
            lambda: (f"see {'_'.join(rng.choice(filler, 5))}_handler there", 0),
        ][kind]()
        before, after = " ".join(rng.choice(filler, 12)), " ".join(rng.choice(filler, 12))
        made.append((i, f"{before} {line} {after}", f"repo/{'config' if kind < 3 else 'docs'}/f{i}.txt", secret))
    return made


def test_secrets_on_held_out_findings(spark):
    """Labels of half of the documents; precision and recall on the others, hashes and identifiers among them."""
    made = secret_documents(1600, 4)
    docs = spark.createDataFrame([(i, t, p) for i, t, p, _ in made], "doc_id long, text string, source string")
    truth = {i: s for i, *_, s in made}
    plain = secrets.findings(docs).collect()
    labelled = [(r.doc_id, r.start, bool(truth[r.doc_id])) for r in plain if r.doc_id // 8 % 2 == 0]
    table = spark.createDataFrame(labelled + [(10**6, 3, True)], "doc_id long, start long, is_secret boolean")
    # Forms alone tell of the one kind of key that has one, and of little else.
    for rows, least in ((secrets.findings(docs, table).collect(), 0.95), (plain, 0.33)):
        held = [(truth[r.doc_id], r.is_secret) for r in rows if r.doc_id // 8 % 2]
        caught = sum(t and p for t, p in held)
        precision, recall = caught / max(1, sum(p for _, p in held)), caught / sum(t for t, _ in held)
        print("precision", precision, "recall", recall)
        assert precision >= 0.95 and recall >= least
        assert len({r.doc_id for r in rows}) == len(made)


def test_dictionary_has_letters_of_any_script(spark):
    rows = spark.createDataFrame([(i, "größe niño français und abc1 été") for i in range(3)], "doc_id long, text string")
    assert {"größe", "niño", "été", "und"} <= secrets.dictionary(rows) and "abc1" not in secrets.dictionary(rows)


def test_secrets_by_context():
    """Short, punctuated and dotted values after key words and in URLs, and each long run once."""
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP-mB92K27u"
    run = "0123456789abcdef0123"
    for text, expected in (
        ('password = "Tr0ub4dor&3", pwd: hunter2024, and', ["Tr0ub4dor&3", "hunter2024"]),
        ("postgres://app:s3cr3tPw@host/db redis://:p@ss!@h", ["s3cr3tPw", "p@ss!"]),
        (f"Bearer {jwt} token: {jwt}.", [jwt, jwt]),
        (f'API-KEY="{run}" and {run} DB_PASSWD={run}', [run, run, run]),
        ("{'passwd': 'a b\\'c'} (secret=x(1)) ?token=ab1&user=2", ["a b\\'c", "x(1)", "ab1"]),
        ("the password is old, tokens: 5", []),
        ('{"password":12345,"pwd":""} token=ab,secret:cd;x=1', ["12345", "ab", "cd"]),
        (f"my_long_service_token=ab1 {'x' * 16}", ["ab1", "x" * 16]),
    ):
        assert [text[a:b] for a, b in secrets.spans(text)] == expected


def test_dictionary_counts_all_documents(spark):
    """Words of a source with one document in a thousand are in it, also of a large table."""
    rows = [(i, "common words", None, "a", None) for i in range(5000)] + [(9000 + i, "seldom " + "abcdef"[i] * 4, None, "b", None) for i in range(5)]
    assert secrets.dictionary(spark.createDataFrame(rows, DOCS)) == {"common", "words", "seldom", "aaaa", "bbbb", "cccc", "dddd", "eeee"}


# --- pipeline -----------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, FOLDER)
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > 0
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes[4]


@pytest.mark.parametrize("units", [["hello"], ["a"], ["ab", "cd"], ["abcdefghij"], ["abcdefghij", "bcdefghijk"], ["abcdefghijklmnopq"], ["a", "abcdefghij", "abcdefghijklmnopq"], ["x" * 40]])
def test_few_units_of_a_length(spark, units):
    coder = pieces.Pieces(pieces.model_bytes(spark, pieces.model_path()))
    for text in (units[0], " ".join(units)):
        (ids,) = coder.encode([text])
        assert ids.tolist() == coder.library.encode(text, add_bos=True, add_eos=True)
        assert coder.decode([ids]) == [coder.library.decode(ids.tolist())]


def test_tokens_one_row_a_batch(spark):
    model = pieces.model_bytes(spark, pieces.model_path())
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["hello", "", None, "two words", "hello"])], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = {r.doc_id: r.n_tokens for r in pieces.encoded(rows.repartition(5), model).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[1] == found[2] == 2 and found[0] == found[4] > 2 and len(found) == 5


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    """Nulls, repeated rows, very long texts and clashing names through every stage, and an empty table."""
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for name, apply in corpus_pipeline.STAGES[:-1]:
            now = apply(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
            now = corpus_pipeline.stage(now, "odd")
        rows = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert all(r.n_tokens >= 2 for r in rows)
        # Of copies 1 and 2 one is left, short texts and those without words are gone, and the null id is a document.
        assert {r.doc_id for r in rows} <= {1, 9, 10, 11, 12, 13, None} if table is docs else not rows
