"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from rollkeeper.llm.quality import ERROR, GRIDS, RISK

BLANK = r"\x20\x09-\x0D"
WORDS = f"regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+')"

_MEASURES = {
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words",
    "short_words": "-(word_chars / n_words)",
}
_GRID = ", ".join(f"('{rule}', {cut!r}::DOUBLE)" for rule, cuts in GRIDS.items() for cut in cuts)
_MEASURE = " ".join(f"WHEN '{rule}' THEN {m}" for rule, m in _MEASURES.items())

OP3 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {WORDS} AS w, coalesce(text, '') AS text FROM documents
), windows AS (
  SELECT rid, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g FROM docs, unnest(range(1, len(w) - 1)) AS u(i)
), twice AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY rid
), lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM docs, unnest(string_split(text, chr(10))) AS u(line)
  WHERE regexp_matches(line, '[^{BLANK}]') GROUP BY rid
), counts AS (
  SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[{BLANK}]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), grid(rule, cut) AS (VALUES {_GRID}),
measured AS (
  SELECT rid, rule, cut, CASE WHEN n_words > 0 THEN CASE rule {_MEASURE} END ELSE 0.0 END AS measure FROM based, grid
), marks AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)
), good AS (
  SELECT based.* FROM based JOIN marks USING (doc_id) WHERE quality = 1 AND NOT base_failed
), seen AS (
  SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (measure > cut) AS k
  FROM good JOIN measured USING (rid) GROUP BY lang, rule, cut
), tested AS (
  SELECT *, {RISK} / {len(GRIDS)} AS p, (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)) * {len(GRIDS)} AS tests FROM seen
), tests_sum AS (
  SELECT lang, rule, cut, n, k, p, tests,
         list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) AS chance
  FROM tested
), passed AS (
  SELECT lang, rule, cut, min((k <= n * p AND chance <= {ERROR} / tests)::INT) OVER (PARTITION BY lang, rule ORDER BY cut DESC) AS ok FROM tests_sum
), cuts AS (
  SELECT lang, rule, min(cut) AS cut FROM passed WHERE ok = 1 GROUP BY lang, rule
), rejected AS (
  SELECT DISTINCT measured.rid FROM measured JOIN based USING (rid)
  JOIN cuts ON cuts.rule = measured.rule AND cuts.cut = measured.cut AND cuts.lang IS NOT DISTINCT FROM based.lang
  WHERE measure > cuts.cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM rejected) AS kept
FROM based
"""

OP5 = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BLANK}]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + 4], chr(32)) AS s FROM docs, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), sizes AS (
  SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), common AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes AS x ON x.rid = a JOIN sizes AS y ON y.rid = b
  WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached(rid, other) AS (
  SELECT rid, rid FROM docs UNION SELECT rid, ways.b FROM reached JOIN ways ON other = ways.a
), lowest AS (
  SELECT reached.rid AS rid, min(docs.doc_id) AS component_id FROM reached JOIN docs ON docs.rid = other GROUP BY reached.rid
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs LEFT JOIN sizes USING (rid) JOIN lowest USING (rid)
"""

OP6 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT rid, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs, unnest(range(1, len(ls) + 1)) AS u(i)
), often AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3
), judged AS (
  SELECT rid, lines.doc_id, i, line, often.key IS NOT NULL AND lines.doc_id IS DISTINCT FROM keeper AS dropped
  FROM lines LEFT JOIN often USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""

OP10 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12) AS place FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM docs GROUP BY source
), shares(pass, source, source_size, weight, target) AS (
  -- Words that sources at their limit leave are shared again, until none is above it.
  SELECT 0, source, source_size, weight, 1.5 * (SELECT sum(source_size) FROM sizes) * weight / (SELECT sum(weight) FROM sizes) FROM sizes
  UNION ALL
  SELECT pass + 1, source, source_size, weight,
         CASE WHEN target >= 2 * source_size THEN 2.0 * source_size
              ELSE (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) FILTER (target >= 2 * source_size) OVER (), 0)) * weight
                   / sum(weight) FILTER (target < 2 * source_size) OVER () END
  FROM shares WHERE pass < 200
), goals AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM shares WHERE pass = 200
), places AS (
  SELECT source, place, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto FROM docs GROUP BY source, place
), taken AS (
  SELECT places.source, place, copies + (upto <= lft OR (upto - words <= lft AND words - (lft - (upto - words)) < lft - (upto - words)))::INT AS times
  FROM places JOIN (SELECT *, target - copies * source_size AS lft FROM goals) AS g ON places.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (least(times, 2) * size)::BIGINT AS taken
FROM docs JOIN goals ON docs.source IS NOT DISTINCT FROM goals.source
JOIN taken ON docs.source IS NOT DISTINCT FROM taken.source AND docs.place = taken.place
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents
), sized AS (
  SELECT rid, doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), total AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized
), asked AS (
  SELECT iid, item_id, term, count(*)::BIGINT AS times
  FROM (SELECT iid, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS terms FROM benchmark))
  GROUP BY iid, item_id, term
), held AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY rid, doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term
), impacts AS (
  SELECT rid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)) AS impact FROM held, total
), scores AS (
  SELECT iid, item_id, rid, doc_id, sum(times * w * impact)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY iid, item_id, rid, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id, rid)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

OP12 = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.vector, b.vector)::BIGINT AS score
  FROM vectors AS a JOIN vectors AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

ORACLES = {
    "op3_quality_rules": OP3,
    "op5_minhash_near_dedup": OP5,
    "op6_line_dedup": OP6,
    "op10_source_mixing": OP10,
    "op12_hard_negatives": OP12,
    "op13_ranked_search": OP13,
}
