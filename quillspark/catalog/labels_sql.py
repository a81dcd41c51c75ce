"""SQL statements of the labeling, agreement, retrieval and pattern queries."""

import zlib

_TOKENS = "list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> '')"

_ROLLING = """
w AS (SELECT x.{keys}, x.i, y.a, y.b FROM r x JOIN r y ON {same} y.i BETWEEN x.i - {back} AND x.i),
c AS (SELECT {keys}, i, v, sum(CASE WHEN a = v THEN 1 ELSE 0 END) AS na, sum(CASE WHEN b = v THEN 1 ELSE 0 END) AS nb
  FROM (SELECT w.*, u.v FROM w JOIN (SELECT DISTINCT a AS v FROM r UNION SELECT DISTINCT b FROM r) u ON true) GROUP BY ALL),
m AS (SELECT {keys}, i, sum(na * nb) AS marginal FROM c GROUP BY ALL),
n AS (SELECT {keys}, i, count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS agree FROM w GROUP BY ALL)
"""

_KAPPA = "CASE WHEN n * n = marginal THEN NULL ELSE round(CAST(n * agree - marginal AS DOUBLE) / CAST(n * n - marginal AS DOUBLE), 9) END AS kappa"

_REVIEWS = """
WITH s AS (SELECT doc_id, lang, n_chars AS sa, n_chars + doc_id % 4 AS sb FROM documents),
f AS (SELECT *, sa % 3 <> 0 AND (sa % 2 = 0 OR (sa % 5 <> 0 AND sa % 2 <> 0)) AND (sa % 2 = 0 OR sa % 5 <> 0) AS pa,
  sb % 3 <> 0 AND (sb % 2 = 0 OR sb % 5 <> 0) AS pb FROM s),
kept AS (SELECT * FROM f WHERE pa AND pb)
"""

_FINAL = """
finals AS (SELECT doc_id, CASE WHEN quality = toxic THEN 'agreement' ELSE 'adjudicator:adjudicator_1' END AS decided_by,
  '{"quality":' || quality || '}' AS label_json, 1704067200 + doc_id * 13 % 997 AS labeled_at FROM labels)
"""

_LABELED = """
WITH t AS (SELECT *, """ + _TOKENS.format(text="text") + """ AS w FROM documents),
v AS (SELECT *, n_chars >= 400 AS a, len(w) >= 100 AS b,
  coalesce(CAST(len(list_distinct(w)) AS DOUBLE) / nullif(len(w), 0) >= 0.85, false) AS j FROM t),
l AS (SELECT *, CASE WHEN a = b THEN a ELSE j END AS f,
  CASE WHEN a = b THEN 'agreement' ELSE 'adjudicator:adjudicator_1' END AS decided_by FROM v)
"""

_CALLED = """
WITH v AS (SELECT source, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
l AS (SELECT *, n >= 400 AS a, n >= 1000 AS b FROM v),
c AS (SELECT *, CASE WHEN a = b THEN a ELSE n % 2 = 0 END AS f,
  CASE WHEN a = b THEN 'agreement' ELSE 'adjudicator:adjudicator_1' END AS decided_by FROM l)
"""

_DIST = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.vec_id, x.vec_id AS neighbor_id, x.label AS neighbor_label,
  list_sum(list_transform(list_zip(q.v, x.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM e q JOIN e x ON {on}),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM pairs
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) <= {k})
"""
_RANKED = "SELECT vec_id, neighbor_id, rank, round(d, 6) AS distance FROM near"
_ALL = "q.vec_id <> x.vec_id"

_USAGE = """CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(c) AS BIGINT) AS cached_input_tokens,
  CAST(0 AS BIGINT) AS cached_output_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens, count(*) AS total_calls,
  count(*) FILTER (WHERE hit) AS cached_calls, printf('%.1f%%', CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) * 100) AS cache_hit_rate
FROM (SELECT role, CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS i, CASE WHEN role = 'user' THEN 0 ELSE length(text) END AS o,
  length(text) % 7 AS c, turn % 3 = 1 AS hit FROM conversations)"""

_FILES = """
WITH r AS (SELECT l.*, d.source, d.lang, '/out/' || d.source || '/' || l.doc_id || '.json' AS path,
  toxic = 1 OR quality = 0 AS hit, d.lang <> 'fr' AS works FROM labels l JOIN documents d USING (doc_id))
"""

SQL = {
    "kappa_overall": """
WITH r AS (SELECT count(*) AS n, sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS agree,
  sum(quality) * sum(toxic) + sum(1 - quality) * sum(1 - toxic) AS marginal FROM labels)
SELECT n, """ + _KAPPA + " FROM r",
    "kappa_by_lang": """
WITH r AS (SELECT lang, count(*) AS n, sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS agree,
  sum(quality) * sum(toxic) + sum(1 - quality) * sum(1 - toxic) AS marginal FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n, """ + _KAPPA + " FROM r",
    "rolling_kappa_w50": """
WITH r AS (SELECT doc_id, quality AS a, toxic AS b, row_number() OVER (ORDER BY doc_id) AS i FROM labels),
""" + _ROLLING.format(keys="doc_id", same="", back=49) + """
SELECT doc_id, 'label' AS field, n, """ + _KAPPA + " FROM n JOIN m USING (doc_id, i)",
    "rolling_kappa_multi_field": _REVIEWS + """,
b AS (SELECT doc_id, 'detail.fit' AS field, CASE WHEN sa % 7 < 5 THEN 'yes' ELSE 'no' END AS a, CASE WHEN sb % 7 < 5 THEN 'yes' ELSE 'no' END AS b FROM kept
  UNION ALL SELECT doc_id, 'confidence_score', CASE WHEN sa % 100 < 60 THEN 'low' WHEN sa % 100 < 85 THEN 'mid' ELSE 'high' END,
    CASE WHEN sb % 100 < 60 THEN 'low' WHEN sb % 100 < 85 THEN 'mid' ELSE 'high' END FROM kept WHERE lang <> 'es'),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY doc_id) AS i FROM b),
""" + _ROLLING.format(keys="doc_id, x.field", same="x.field = y.field AND", back=29).replace("SELECT doc_id, x.field, i", "SELECT doc_id, field, i") + """
SELECT doc_id, 1704067200 + doc_id AS at, field, n, """ + _KAPPA + " FROM n JOIN m USING (doc_id, field, i)",
    "combination_filter": _REVIEWS + "SELECT doc_id FROM kept",
    "pairwise_labels": """
SELECT doc_id, 1704067200 + greatest(doc_id, doc_id * 7 % 1000) AS at, '{"value":' || quality || '}' AS a_label_json,
  '{"value":' || toxic || '}' AS b_label_json FROM labels""",
    "upsert_latest_label": """
SELECT user_id AS doc_id, event_type AS agent_id, props AS label_json, event_id AS seq FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "upsert_final_label": """
SELECT user_id AS doc_id, event_type AS decided_by, props AS label_json, event_id AS seq FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "promoted_fields": "SELECT event_id, props->>'$.k' AS k, CAST(NULL AS VARCHAR) AS missing FROM events",
    "assigned_ids": "SELECT source, doc_id AS line, 1000 + row_number() OVER (ORDER BY source, doc_id) AS doc_id FROM documents",
    "confidence_bucket": """
SELECT CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_quantity / 50 < 0.6 THEN 'low' WHEN l_quantity / 50 < 0.85 THEN 'mid' ELSE 'high' END AS bucket,
  count(*) AS rows FROM lineitem GROUP BY 1""",
    "unlabeled_docs": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "fetch_examples": "WITH " + _FINAL + """
SELECT doc_id, source, decided_by, label_json, labeled_at, md5(text) AS text_md5 FROM finals JOIN documents USING (doc_id)
WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "label_documents": _LABELED + """
SELECT doc_id, lang, source, '{"is_good":' || a || '}' AS label_a, '{"is_good":' || b || '}' AS label_b, '{"is_good":' || f || '}' AS final_label,
  decided_by FROM l""",
    "agreement_summary": _LABELED + """
SELECT lang, decided_by, count(*) AS documents, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY lang), 1) AS percent
FROM l GROUP BY lang, decided_by""",
    "flag_summary": _LABELED + """
SELECT count(*) AS total, count(*) FILTER (WHERE f) AS related, printf('%.1f%%', CAST(count(*) FILTER (WHERE f) AS DOUBLE) / count(*) * 100) AS related_percent,
  count(*) FILTER (WHERE NOT f) AS unrelated, printf('%.1f%%', CAST(count(*) FILTER (WHERE NOT f) AS DOUBLE) / count(*) * 100) AS unrelated_percent FROM l""",
    "decided_by_errors": """
WITH v AS (SELECT doc_id, lang, n_chars >= 400 AS a, n_chars % 2 = 0 AS b, doc_id % 3 = 0 AS j FROM documents)
SELECT doc_id, CASE WHEN lang = 'es' THEN NULL WHEN a = b OR lang = 'fr' THEN '{"is_good":' || a || '}' ELSE '{"is_good":' || j || '}' END AS final_label,
  CASE WHEN lang = 'es' THEN 'error' WHEN a = b THEN 'agreement' WHEN lang = 'fr' THEN 'error_fallback_to_a'
    ELSE 'adjudicator:adjudicator_1' END AS decided_by FROM v""",
    "prompt_render": """
SELECT doc_id, md5('[SYSTEM]' || chr(10) || 'You are labeler_a. good or not' || chr(10) || chr(10) || '[HUMAN]' || chr(10) || chr(10) || text) AS prompt_md5,
  substr(md5(text), 1, 8) AS content_hash FROM documents""",
    "snippets": """
SELECT doc_id, md5(CASE WHEN length(text) > 900 THEN substr(text, 1, 900) || '...' ELSE text END) AS snippet_md5,
  md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '... (truncated)' ELSE text END) AS code_md5,
  length(regexp_replace(substr(text, 1, 300), '^\\s+|\\s+$', '', 'g')) + CASE WHEN length(text) > 300 THEN 3 ELSE 0 END AS reference_length
FROM documents""",
    "cache_lookup": """
WITH r AS (SELECT source, lang, sha256(concat_ws(chr(1), 'default', '0.1', text)) AS key FROM documents),
h AS (SELECT DISTINCT key FROM r WHERE lang = 'en')
SELECT source, count(*) FILTER (WHERE key IN (SELECT key FROM h)) AS hits,
  count(DISTINCT CASE WHEN key NOT IN (SELECT key FROM h) THEN key END) AS to_call FROM r GROUP BY source""",
    "token_usage_summary": "SELECT " + _USAGE,
    "token_usage_by_role": "SELECT role, " + _USAGE + " GROUP BY role",
    "report_units": """
SELECT 'test_module' AS unit_type, '{"project_name":"' || p || '","file_path":"/repo/' || doc_id || '.py"}' AS unit_id,
  '/repo/' || doc_id || '.py' AS source, p AS meta_source, 'test_module' AS meta_type
FROM (SELECT *, CASE WHEN lang <> 'en' THEN source ELSE 'unknown' END AS p FROM documents) WHERE doc_id % 3 <> 0""",
    "rate_limit_admission": """
WITH r AS (SELECT event_id, epoch_us(ts) / 1000000.0 AS arrived, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
v AS (SELECT event_id, arrived, i, max(arrived - i * 60.0) OVER (ORDER BY i) AS top FROM r)
SELECT event_id, round(greatest(arrived, top + i * 60.0), 3) AS admitted_at FROM v""",
    "rate_limit_by_user": """
WITH r AS (SELECT event_id, user_id, epoch_us(ts) / 100000000.0 AS arrived, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
v AS (SELECT *, max(arrived - i * 30.0) OVER (PARTITION BY user_id ORDER BY i) AS top FROM r)
SELECT event_id, user_id, round(greatest(arrived, top + i * 30.0 - 30.0), 3) AS admitted_at FROM v""",
    "worker_assignment": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS worker FROM documents",
    "knn_top5": _DIST.format(on=_ALL, k=5) + _RANKED,
    "knn_oversampled": _DIST.format(on=_ALL, k=3) + _RANKED,
    "knn_earlier": _DIST.format(on="x.vec_id < q.vec_id", k=3) + _RANKED,
    "knn_repeated_ids": """
WITH e AS (SELECT vec_id, vec_id // 4 AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.id, x.id AS neighbor_id,
  list_sum(list_transform(list_zip(q.v, x.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM e q JOIN e x ON q.vec_id % 4 = 0 AND q.id <> x.id),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor_id) AS rank FROM pairs)
SELECT id, rank, round(d, 6) AS distance FROM near WHERE rank <= 5""",
    "knn_two_batches": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT b AS batch, q.vec_id, x.vec_id AS neighbor_id, list_sum(list_transform(list_zip(q.v, x.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM e q JOIN e x ON q.vec_id <> x.vec_id JOIN (VALUES (0), (1)) t(b) ON x.vec_id % 2 <= b),
near AS (SELECT *, row_number() OVER (PARTITION BY batch, vec_id ORDER BY d, neighbor_id) AS rank FROM pairs)
SELECT batch, vec_id, neighbor_id, rank, round(d, 6) AS distance FROM near WHERE rank <= 3""",
    "knn_missing_vector": _DIST.format(on=_ALL + " AND q.vec_id % 7 <> 0 AND x.vec_id % 5 <> 0", k=3) + _RANKED,
    "same_names": """
SELECT p_partkey AS item, min(p_partkey) OVER (PARTITION BY list_sort(list_distinct(string_split(lower(p_name), ' ')))) AS first_item FROM part""",
    "typed_conditions": """
SELECT doc_id, doc_id % 8 IN (0, 2, 3) AS number, doc_id % 8 = 1 AS text, doc_id % 8 IN (4, 7) AS absent, doc_id % 8 IN (0, 2, 3) AS flag
FROM documents""",
    "label_corpus_twice": _CALLED + """
SELECT source, decided_by, count(*) AS documents, CAST(sum(CASE WHEN f THEN {yes} ELSE {no} END) AS BIGINT) AS labels FROM c GROUP BY ALL""".format(
        yes=zlib.crc32(b'{"is_good":true}'), no=zlib.crc32(b'{"is_good":false}')),
    "label_corpus_usage": _CALLED + """,
asks AS (SELECT 'labeler_a' AS agent_id, 'CODE:' || text AS t, 'a' AS s FROM c UNION ALL SELECT 'labeler_b', 'CODE:' || text, 'b' FROM c
  UNION ALL SELECT 'adjudicator_1', '{"is_good":' || a || '}{"is_good":' || b || '}CODE:' || text, 'j' FROM c WHERE a <> b),
n AS (SELECT agent_id, t, s, count(*) AS k FROM asks GROUP BY ALL)
SELECT agent_id, CAST(sum(length('[SYSTEM]' || s || '[HUMAN]' || t) + 4) AS BIGINT) AS input_tokens, 2 * count(*) AS output_tokens,
  CAST(2 * sum(k) AS BIGINT) AS total_calls, CAST(2 * sum(k) - count(*) AS BIGINT) AS cached_calls FROM n GROUP BY agent_id""",
    "knn_confident": _DIST.format(on=_ALL, k=5) + """
SELECT vec_id, neighbor_id, round(1 / (1 + sqrt(d)), 6) AS score, 1 / (1 + sqrt(d)) >= 0.5 AS is_confident,
  bool_or(1 / (1 + sqrt(d)) >= 0.5) OVER (PARTITION BY vec_id) AS has_confident_matches FROM near""",
    "knn_label_vote": _DIST.format(on=_ALL, k=5) + """,
votes AS (SELECT vec_id, neighbor_label AS label, count(*) AS votes FROM near GROUP BY 1, 2)
SELECT vec_id, CAST(label AS BIGINT) AS label, votes FROM votes
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) = 1""",
    "examples_block": _DIST.format(on=_ALL, k=5) + "," + _FINAL + """,
b AS (SELECT near.vec_id, f.labeled_at, f.doc_id, 'Example doc_id=' || f.doc_id || chr(10) || 'Document snippet:' || chr(10) ||
    CASE WHEN length(text) > 900 THEN substr(text, 1, 900) || '...' ELSE text END || chr(10) || chr(10) || 'Final label:' || chr(10) ||
    replace(replace(label_json, '{"quality":', '{' || chr(10) || '  "quality": '), '}', chr(10) || '}') AS block
  FROM near LEFT JOIN (SELECT * FROM finals JOIN documents USING (doc_id)) f ON f.doc_id = neighbor_id)
SELECT vec_id, count(block) AS examples, md5('[SYSTEM]' || chr(10) || 's' || chr(10) || chr(10) || '[HUMAN]' || chr(10) ||
  coalesce(string_agg(block, chr(10) || chr(10) ORDER BY labeled_at DESC, doc_id), 'No similar past labeled examples were found.')) AS prompt_md5
FROM b GROUP BY vec_id""",
    "normalized_names": """
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS name_md5
FROM conversations""",
    "similar_names": """
WITH s AS (SELECT min(p_partkey) AS item, t FROM (SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS t FROM part) GROUP BY t),
p AS (SELECT a.item AS item_a, b.item AS item_b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM s a JOIN s b ON a.item < b.item)
SELECT item_a, item_b, round(CAST(i AS DOUBLE) / (n - i), 6) AS similarity FROM p WHERE CAST(i AS DOUBLE) / (n - i) >= 0.3""",
    "word_similarity": """
WITH d AS (SELECT doc_id, list_distinct(""" + _TOKENS.format(text="lower(text)") + """) AS a, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents),
b AS (SELECT item_id, list_distinct(""" + _TOKENS.format(text="lower(text)") + """) AS b FROM benchmark),
j AS (SELECT doc_id, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM d JOIN b USING (item_id))
SELECT doc_id, CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE round(CAST(i AS DOUBLE) / (na + nb - i), 6) END AS jaccard,
  CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE round(CAST(i AS DOUBLE) / greatest(na, nb), 6) END AS overlap FROM j""",
    "pattern_statistics": """
WITH p AS (SELECT label, count(*) AS n, avg((vec_id % 100) / 100.0) AS c, max(vec_id) AS u FROM embeddings GROUP BY label)
SELECT count(*) AS total_patterns, CAST(sum(n) AS BIGINT) AS total_examples, round(avg(c), 6) AS avg_confidence, round(avg(u), 6) AS avg_usage FROM p""",
    "pattern_confidence": """
WITH r AS (SELECT user_id AS pattern_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT pattern_id, round(sum(CASE WHEN i = 1 THEN v ELSE 0.2 * v END * pow(CAST(0.8 AS DOUBLE), n - i)), 6) AS confidence_score, count(*) AS usage_count
FROM r GROUP BY pattern_id""",
    "chunk_assign": """
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS chunk, (row_number() OVER (ORDER BY doc_id) - 1) % 20 + 1 AS index_in_chunk FROM documents""",
    "example_references": """
WITH c AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS chunk, (row_number() OVER (ORDER BY doc_id) - 1) % 20 + 1 AS i FROM documents)
SELECT chunk AS pattern, CAST(r AS BIGINT) AS ref, lang AS file_path, doc_id, source AS project FROM c CROSS JOIN (VALUES (0), (1)) v(r)
WHERE i = CASE WHEN r = 0 THEN 1 ELSE chunk % 20 + 1 END""",
    "consolidated_references": """
WITH c AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS chunk, (row_number() OVER (ORDER BY doc_id) - 1) % 20 + 1 AS i FROM documents),
refs AS (SELECT chunk, lang, doc_id, source FROM c WHERE i = 1 OR i = chunk % 20 + 1),
cited AS (SELECT DISTINCT chunk // 3 AS pattern, CASE WHEN n = 0 THEN chunk ELSE 0 END AS chunk FROM c CROSS JOIN (VALUES (0), (1)) v(n))
SELECT DISTINCT pattern, lang AS file_path, doc_id, source AS project FROM cited JOIN refs USING (chunk)""",
    "alteration_counts": _FILES + """
SELECT 2 * count(*) AS total_items, count(*) FILTER (WHERE hit) AS filtered_items, count(*) FILTER (WHERE hit AND works) AS relabeled_items,
  count(*) FILTER (WHERE hit AND NOT works) AS failed_items, count(*) FILTER (WHERE NOT hit) AS skipped_items FROM r""",
    "altered_entries": _FILES + """
SELECT path, source AS project, 'doc' AS item, CASE WHEN hit AND works THEN 'relabeled' WHEN hit THEN 'failed' ELSE 'skipped' END AS status,
  CASE WHEN hit AND works THEN '{"quality":1,"toxic":0}' ELSE '{"quality":' || quality || ',"toxic":' || toxic || '}' END AS final_label,
  CASE WHEN hit AND works THEN 'label_alterer' ELSE 'agreement' END AS decided_by, hit AND works AS relabeled FROM r
UNION ALL SELECT path, source, 'note', 'other', NULL, NULL, false FROM r""",
    "alteration_errors": _FILES + "SELECT path AS file, 'doc' AS item, 'Relabeling returned None' AS error FROM r WHERE hit AND NOT works",
    "field_value_examples": _FILES + """
SELECT 'doc' AS source, source AS project, CAST(doc_id AS VARCHAR) AS doc_id, 'lang ' || lang AS code, 'No reasoning provided' AS reasoning, path
FROM r WHERE toxic = 1 ORDER BY path LIMIT 10""",
    "label_file_entries": """
WITH l AS (SELECT DISTINCT 'doc "' || doc_id || '", {' || chr(92) AS item, '{"quality":' || quality || ',"toxic":' || toxic || '}' AS final_label
  FROM labels JOIN documents USING (doc_id))
SELECT layout, item, final_label, CAST(1 AS BIGINT) AS files FROM l, (VALUES ('rows'), ('objects')) v(layout)""",
    "ncloc_documents": """
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(#|$)'))) AS ncloc FROM documents""",
    "assertion_names": """
WITH n AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'check' ELSE 'assert' END || replace(lower(p_name || p_type), ' ', '') AS m FROM part)
SELECT p_partkey, CASE WHEN NOT starts_with(m, 'assert') THEN NULL WHEN contains(m, 'equal') THEN 'equality'
  WHEN contains(m, 'true') OR contains(m, 'false') THEN 'truthiness' WHEN contains(m, 'none') OR contains(m, 'null') THEN 'nullness'
  WHEN contains(m, 'is') AND NOT contains(m, 'not') THEN 'identity'
  WHEN contains(m, 'raises') OR contains(m, 'exception') OR contains(m, 'error') OR contains(m, 'warns') THEN 'throwable'
  WHEN contains(m, 'in') OR contains(m, 'contains') OR contains(m, 'count') OR contains(m, 'sequence') THEN 'collection'
  WHEN contains(m, 'greater') OR contains(m, 'less') THEN 'comparison' WHEN contains(m, 'almost') OR contains(m, 'close') THEN 'numeric-tolerance'
  WHEN contains(m, 'type') OR contains(m, 'instance') THEN 'type' WHEN contains(m, 'regex') OR contains(m, 'match') THEN 'string'
  ELSE 'truthiness' END AS assertion_type FROM n""",
    "statement_kinds": """
WITH n AS (SELECT doc_id, lower(text) AS m FROM documents)
SELECT doc_id, CASE WHEN contains(m, ' is none') OR contains(m, ' is not none') THEN 'nullness' WHEN contains(m, ' is ') THEN 'identity'
  WHEN contains(m, '==') OR contains(m, '!=') THEN 'equality' WHEN contains(m, '>') OR contains(m, '<') THEN 'comparison'
  WHEN contains(m, ' in ') THEN 'collection' WHEN contains(m, 'isclose') OR contains(m, 'allclose') THEN 'numeric-tolerance'
  WHEN contains(m, 'isinstance') OR contains(m, 'issubclass') OR contains(m, 'type(') THEN 'type'
  WHEN contains(m, 'startswith') OR contains(m, 'endswith') OR contains(m, 'match') OR contains(m, 'search') THEN 'string'
  ELSE 'truthiness' END AS assertion_type,
  contains(m, 'mock') OR contains(m, 'patch') OR contains(m, 'spy') OR contains(m, 'stub') OR contains(m, 'fake') AS mocks FROM n""",
    "nearest_earlier_value": """
WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
c AS (SELECT q.event_id, q.user_id, f.value, row_number() OVER (PARTITION BY q.event_id ORDER BY f.ts DESC, CAST(f.event_id AS VARCHAR) DESC) AS n
  FROM q LEFT JOIN events f ON f.user_id = q.user_id AND f.event_type = 'click' AND f.ts <= q.ts)
SELECT event_id, user_id, value FROM c WHERE n = 1""",
    "source_ranking": """
WITH c AS (SELECT source, count(*) AS documents FROM documents GROUP BY source)
SELECT row_number() OVER (ORDER BY documents DESC, source) AS rank, source, documents FROM c
UNION ALL SELECT NULL, 'TOTAL', CAST(sum(documents) AS BIGINT) FROM c""",
}

# Ordered walks: each row joins a seed found before it, or becomes one.
_OVERLAP = "len(list_intersect({a}, {b})) / CAST(greatest(len({a}), len({b})) AS DOUBLE)"

SQL["merged_patterns"] = """
WITH RECURSIVE i AS (
  SELECT p_brand AS cat, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n,
    list_distinct(string_split(p_name, ' ')) AS w,
    list_distinct([CAST(p_size % 5 AS VARCHAR), CAST(p_size % 7 AS VARCHAR), lower(p_type)]) AS ind FROM part),
walk AS (
  SELECT DISTINCT cat, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k BIGINT, w VARCHAR[], ind VARCHAR[])[]) AS seeds,
    CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seed FROM i
  UNION ALL
  SELECT cat, n, CASE WHEN hit IS NULL THEN list_append(seeds, {'k': k, 'w': w, 'ind': ind}) ELSE seeds END, k, coalesce(hit, k)
  FROM (SELECT i.*, walk.seeds, list_filter(walk.seeds, lambda x: """ + _OVERLAP.format(a="x.w", b="i.w") + """ > 0.6
      OR """ + _OVERLAP.format(a="x.ind", b="i.ind") + """ > 0.5)[1].k AS hit
    FROM walk JOIN i ON i.cat = walk.cat AND i.n = walk.n + 1)),
m AS (SELECT seed, part.* FROM walk JOIN part ON p_partkey = walk.k)
SELECT seed, first(replace(p_name, ' ', '_') ORDER BY p_size DESC, p_partkey) AS pattern_name, first(p_brand) AS pattern_category,
  round(avg(p_size / 50.0), 6) AS confidence_score, count(*) AS members, count(*) AS example_count,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT unnest([CAST(p_size % 5 AS VARCHAR), CAST(p_size % 7 AS VARCHAR), lower(p_type)]) AS v
     FROM m x WHERE x.seed = m.seed)) AS code_indicators
FROM m GROUP BY seed"""

_GROUPS = """
WITH RECURSIVE i AS (
  SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS n, lower(p_name || CASE WHEN p_size % 4 = 0 THEN ' ' || p_type ELSE '' END) AS name,
    lower(p_type || ' ' || p_brand) AS description, p_size / 50.0 AS c FROM part),
t AS (SELECT *, string_split(name, ' ') AS w, string_split(description, ' ') AS dw FROM i),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k BIGINT, name VARCHAR, w VARCHAR[], dw VARCHAR[])[]) AS seeds, CAST(NULL AS BIGINT) AS k,
    CAST(NULL AS BIGINT) AS seed
  UNION ALL
  SELECT n, CASE WHEN hit IS NULL THEN list_append(seeds, {'k': k, 'name': name, 'w': w, 'dw': dw}) ELSE seeds END, k, coalesce(hit, k)
  FROM (SELECT t.*, walk.seeds, coalesce(list_filter(walk.seeds, lambda x: x.name = t.name)[1].k,
      list_sort(list_transform(list_filter(list_transform(walk.seeds, lambda x: {'k': x.k,
        'ns': CASE WHEN contains(x.name, t.name) OR contains(t.name, x.name)
          THEN CAST(least(length(x.name), length(t.name)) AS DOUBLE) / greatest(length(x.name), length(t.name))
          ELSE CAST(len(list_intersect(x.w, t.w)) AS DOUBLE) / len(list_distinct(list_concat(x.w, t.w))) END,
        'ds': CAST(len(list_intersect(x.dw, t.dw)) AS DOUBLE) / len(list_distinct(list_concat(x.dw, t.dw)))}),
        lambda y: y.ns >= 0.8 OR (y.ns >= 0.5 AND y.ds >= 0.6)), lambda y: {'s': -(y.ns * 0.7::DOUBLE + y.ds * 0.3::DOUBLE), 'k': y.k}))[1].k) AS hit
    FROM walk JOIN t ON t.n = walk.n + 1)),
g AS (SELECT k AS seq, seed AS pattern_seq FROM walk WHERE k IS NOT NULL)
"""

SQL["pattern_groups"] = _GROUPS + "SELECT seq, pattern_seq FROM g"
SQL["created_patterns"] = _GROUPS + """,
r AS (SELECT pattern_seq, c, row_number() OVER (PARTITION BY pattern_seq ORDER BY seq) AS o, count(*) OVER (PARTITION BY pattern_seq) AS m
  FROM g JOIN i ON i.k = g.seq),
e AS (SELECT pattern_seq, sum(CASE WHEN o = 1 THEN c ELSE 0.2 * c END * pow(CAST(0.8 AS DOUBLE), m - o)) AS x, count(*) AS m FROM r GROUP BY 1)
SELECT e.pattern_seq, p_name || CASE WHEN p_size % 4 = 0 THEN ' ' || lower(p_type) ELSE '' END AS pattern_name, round(x, 6) AS confidence_score,
  m AS usage_count, m AS example_count FROM e JOIN part ON p_partkey = e.pattern_seq"""

SQL["stored_patterns"] = f"""
SELECT pattern_seq, 'p' || pattern_seq AS pattern_id, pattern_name, confidence_score, usage_count, example_count FROM ({SQL["created_patterns"]})"""

# Chunks of 20 of the first 50; their names share two words of three, so all merge under the first.
SQL["extracted_patterns"] = """
WITH n AS (SELECT count(*) AS n FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1)
SELECT 'seen ' || least(n, 20) || ' examples' AS pattern_name, CAST(ceil(n / 20.0) AS BIGINT) AS members, n AS example_count FROM n WHERE n > 0"""
SQL["consolidated_patterns"] = """
WITH RECURSIVE e AS (
  SELECT doc_id, row_number() OVER (ORDER BY '/out/' || source || '/' || doc_id || '.json') - 1 AS pos FROM labels JOIN documents USING (doc_id) WHERE toxic = 1),
chunks AS (SELECT pos // 5 AS chunk, arg_min(doc_id, pos) AS first_doc, least(count(*), 2) AS refs FROM e GROUP BY pos // 5),
levels AS (
  SELECT count(*) AS inputs FROM chunks
  UNION ALL SELECT CAST(ceil(inputs / 4.0) AS BIGINT) FROM levels WHERE inputs > 4)
SELECT 'group of ' || (SELECT min(inputs) FROM levels) AS pattern_name, CAST(sum(refs) AS BIGINT) AS example_count FROM chunks HAVING count(*) > 3
UNION ALL SELECT 'case ' || first_doc, refs FROM chunks WHERE (SELECT count(*) FROM chunks) <= 3"""

SQL["streamed_confidence"] = SQL["pattern_confidence"]
