"""DuckDB SQL for the rows of the queries that SQL can express."""

OP9 = r"""
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT page_id, row_number() OVER () AS rid,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT p.page_id, p.host, p.path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.rid, p.page_id, p.host, p.path
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT rid, i, list_slice(words, i, i + 7) AS w
  FROM d, unnest(range(1, len(words) - 6)) AS t(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, range(0, 8) AS t(j) GROUP BY rid),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    len(list_filter(words, lambda x: ends_with(x, '!!'))) AS n_shouted,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid)),
f AS (
  SELECT *, (
    (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (10 * word_chars < 20 * n_words OR 10 * word_chars > 250 * n_words) THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_shouted > 50 * n_words THEN 32 ELSE 0 END))::INTEGER AS fail_mask
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_mask & 3) <> 0 AS base_failed, fail_mask = 0 AS kept, fail_mask, 'v1' AS policy
FROM f
"""

#: The ablation of every rule of policy v1, over the same masks.
ABLATION = OP10[: OP10.rindex("SELECT doc_id, n_words, word_chars")].rstrip() + r""",
r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('word_length', 8), ('duplicate_lines', 16), ('shouting', 32))
SELECT rule, count(*) FILTER ((fail_mask & bit) <> 0) AS n_failed, count(*) FILTER (fail_mask = bit) AS n_failed_alone, count(*) FILTER (fail_mask = 0 OR fail_mask = bit) AS n_kept_without, 'v1' AS policy
FROM f, r GROUP BY rule
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, list_slice(words, i, i + least(len(words), 10) - 1) AS w, least(len(words), 10) AS k
  FROM b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT k FROM phrases),
win AS (
  SELECT rid, k, i, list_slice(words, i, i + k - 1) AS w
  FROM d, sizes, unnest(range(1, greatest(len(words) - k + 2, 1))) AS t(i)),
hits AS (SELECT win.rid, win.i, win.k, phrases.item_id FROM win JOIN phrases ON win.k = phrases.k AND win.w = phrases.w),
n AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, k)) AS t(j) GROUP BY rid),
it AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""

OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(list_slice(words, i, i + 4), ' ') AS g
  FROM d, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS t(i) WHERE len(words) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY x.rid, y.rid),
links AS (SELECT a, b FROM o JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT x.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(y.doc_id) AS component_id
FROM d x JOIN reach ON reach.a = x.rid JOIN d y ON y.rid = reach.b LEFT JOIN n ON n.rid = x.rid
GROUP BY x.rid, x.doc_id, n.n
"""

OP11 = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY 1, 2),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, i::INTEGER AS step, substr(filter_order, i, 1) AS filter, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS before FROM o, range(1, 6) AS t(i)),
r AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""

OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('29|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS tie
  FROM documents),
s AS (SELECT name, source_size, [5, 2, 1][((row_number() OVER (ORDER BY name)) - 1) % 3 + 1] AS w FROM (SELECT name, sum(size)::BIGINT AS source_size FROM d GROUP BY 1)),
u(round, level, stopped) AS (
  SELECT 0, (SELECT sum(source_size) / sum(w) FROM s), 0
  UNION ALL
  SELECT * FROM (
    SELECT round + 1, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (level * w > 3 * source_size), 0)) / sum(w) FILTER (level * w <= 3 * source_size) FROM s) AS level,
      (SELECT count(*) FROM s WHERE level * w > 3 * source_size) AS now
    FROM u) WHERE now > (SELECT max(stopped) FROM u) AND level IS NOT NULL),
e AS (SELECT name, source_size, least((3 * source_size)::DOUBLE, (SELECT arg_max(level, round) FROM u) * w) AS target FROM s),
q AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS quota FROM e),
p AS (
  SELECT doc_id, size, source_size, target, quota,
    coalesce(sum(size) OVER (PARTITION BY name ORDER BY tie, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM d JOIN q USING (name))
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, quota - begin_at)) + greatest(0, least(size, quota - source_size - begin_at)) + greatest(0, least(size, quota - 2 * source_size - begin_at)))::BIGINT AS taken
FROM p
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
t AS (SELECT rid, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n_lang) AS whole FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n_lang, v.v, v.whole, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (own + 5 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (n_lang + 5)) // (whole + 5 * v))::BIGINT AS q
  FROM x),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms QUALIFY rank <= 50
"""
