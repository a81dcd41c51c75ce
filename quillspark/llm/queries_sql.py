"""SQL that states the results of the queries which SQL can express."""

SQL = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (
  SELECT line_key, max(doc_id) AS keeper FROM lines WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, c.keeper IS NOT NULL AND c.keeper <> l.doc_id AS dropped
  FROM lines l LEFT JOIN common c USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
b AS (
  SELECT *, list_aggregate(list_transform([1, 11, 21, 31], lambda i: translate(
           to_base(('0x' || substr(hex, i, 10))::BIGINT, 32, 8),
           '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), 'string_agg', '') AS digest
  FROM g)
SELECT page_id, strlen(payload) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b""",
    "op9_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN sides l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op11_collocations": r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, words[i:i + d - 1] AS ph, d, count(*) AS a
  FROM (SELECT lang, words, d, unnest(range(1, len(words) - d + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS d) WHERE len(words) >= d)
  GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.ph, c.d, c.a, k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, d)) AS k FROM f WHERE d > 1) c
  JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:k] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
around AS (
  SELECT lang, ph[i:i + m - 1] AS ph, max(a) AS longer
  FROM (SELECT lang, ph, a, m, unnest(range(1, d - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE m < d) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank
  FROM best LEFT JOIN around USING (lang, ph) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_url_filter": r"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
base(rhost, rpath, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS fixed
  FROM (SELECT DISTINCT host, path FROM p) JOIN base ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
k AS (
  SELECT p.*, rule, fixed, regexp_extract(path, '([^/]*)$', 1) AS page FROM p LEFT JOIN fits USING (host, path)),
t AS (
  SELECT page_id, host, path, rule, fixed, list_sort(list_filter([
      'tld:' || regexp_extract(host, '([^.]*)$', 1), 'site:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'name:' || regexp_extract(host, '^([^.]*)\.', 1),
      'host:' || host, 'dir:' || regexp_extract(path, '^/([^/]+)/', 1),
      'page:' || CASE WHEN regexp_matches(page, '^[0-9]+(\.|$)') THEN 'number' WHEN page <> '' THEN 'word' WHEN ends_with(path, '/') THEN 'folder' ELSE '' END,
      'ext:' || regexp_extract(page, '\.([^.]+)$', 1), 'query:' || regexp_extract(url, '^[^?#]*\?([^#&=]*)', 1),
      'mark:' || CASE WHEN contains(url, '#') THEN 'yes' ELSE '' END], lambda x: NOT ends_with(x, ':') OR length(split_part(x, ':', 2)) > 0)) AS tokens FROM k),
labelled AS (SELECT tokens, fixed FROM t WHERE rule IS NOT NULL),
n AS (SELECT count(*) AS n, greatest(ceil(0.01::DOUBLE * count(*)), 10) AS least FROM labelled),
parts AS (
  SELECT list_filter(tokens, lambda x, i: (m >> (i - 1)::INTEGER) & 1 = 1) AS part, fixed
  FROM (SELECT tokens, fixed, unnest(range(1, 1 << len(tokens)))::INTEGER AS m FROM labelled)),
sets AS (SELECT part, count(*) AS uses FROM parts GROUP BY part),
mined AS (
  SELECT part, fixed AS verdict, count(*)::DOUBLE / any_value(uses) AS confidence, count(*)::DOUBLE / (SELECT n FROM n) AS support
  FROM parts JOIN sets USING (part) GROUP BY part, fixed
  HAVING count(*) >= (SELECT least FROM n) AND count(*)::DOUBLE / any_value(uses) >= 0.6),
rules AS (
  SELECT part, verdict, confidence, support FROM mined x WHERE NOT EXISTS (
    SELECT 1 FROM mined y WHERE y.verdict = x.verdict AND y.confidence >= x.confidence AND len(y.part) < len(x.part) AND list_has_all(x.part, y.part))),
decided AS (
  SELECT * FROM (
    SELECT s.tokens, verdict, confidence, array_to_string(part, ',') AS reason, row_number() OVER (
             PARTITION BY s.tokens ORDER BY confidence DESC, support DESC, len(part), array_to_string(part, ',')) AS place
    FROM (SELECT DISTINCT tokens FROM t WHERE rule IS NULL) s JOIN rules ON list_has_all(s.tokens, part)) WHERE place = 1)
SELECT page_id, host, path, rule, coalesce(fixed, verdict, 'allow') AS verdict,
       CASE WHEN rule IS NULL THEN reason END AS reason, CASE WHEN rule IS NULL THEN confidence END AS confidence
FROM t LEFT JOIN decided ON t.rule IS NULL AND t.tokens = decided.tokens""",
    "op13_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, row_number() OVER () AS pos
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.pos AS anchor_pos, b.vec_id, b.pos, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.pos <> b.pos WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, anchor_pos, vec_id AS positive_id, pos AS positive_pos, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_pos ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN s ON s.anchor_pos = p.anchor_pos AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_pos, positive_pos ORDER BY score DESC, s.vec_id) QUALIFY rank <= 5""",
}
