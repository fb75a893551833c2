"""DuckDB SQL for the training-data queries."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY 1),
ln AS (SELECT doc_id, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS dup
  FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w)),
c AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    dup::BIGINT AS n_dup_lines, n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    100 * word_chars // greatest(n_words, 1) AS word_length, 10000 * n_symbols // greatest(word_chars, 1) AS symbol_rate,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate
  FROM c),
m AS (
  SELECT doc_id, lang, source, 'word_length' AS metric, word_length AS v, 20 AS spread, true AS two FROM b WHERE NOT base_failed
  UNION ALL SELECT doc_id, lang, source, 'symbol_rate', symbol_rate, 50, false FROM b WHERE NOT base_failed
  UNION ALL SELECT doc_id, lang, source, 'dup_line_rate', dup_line_rate, 50, false FROM b WHERE NOT base_failed
  UNION ALL SELECT doc_id, lang, source, 'repeat_rate', repeat_rate, 40, false FROM b WHERE NOT base_failed),
h AS (SELECT *, 16 * e + (v >> e) AS bucket FROM (SELECT *, greatest(length(bin(v)) - 5, 0)::INTEGER AS e FROM m)),
lv AS (
  SELECT 0 AS level, lang, source, metric, spread, two, bucket, v FROM h
  UNION ALL SELECT 1, lang, NULL, metric, spread, two, bucket, v FROM h
  UNION ALL SELECT 2, NULL, NULL, metric, spread, two, bucket, v FROM h),
hist AS (SELECT level, lang, source, metric, spread, two, bucket, count(*) AS n FROM lv GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM hist),
qb AS (
  SELECT level, lang, source, metric, spread, two, total, min(bucket) FILTER (4 * seen >= total) AS b1, min(bucket) FILTER (4 * seen >= 3 * total) + 1 AS b3
  FROM cum GROUP BY ALL),
q AS (
  SELECT *, CASE WHEN b1 < 32 THEN b1 ELSE (b1 - 16 * (b1 // 16 - 1)) << (b1 // 16 - 1)::INTEGER END AS q1,
    CASE WHEN b3 < 32 THEN b3 ELSE (b3 - 16 * (b3 // 16 - 1)) << (b3 // 16 - 1)::INTEGER END - 1 AS q3 FROM qb),
q_lang AS (
  SELECT l.lang, l.metric, (l.total::BIGINT * l.q1 + 100 * g.q1) // (l.total::BIGINT + 100) AS q1, (l.total::BIGINT * l.q3 + 100 * g.q3) // (l.total::BIGINT + 100) AS q3
  FROM q l JOIN q g ON g.level = 2 AND g.metric = l.metric WHERE l.level = 1),
q_own AS (
  SELECT o.lang, o.source, o.metric, o.spread, o.two, (o.total::BIGINT * o.q1 + 100 * l.q1) // (o.total::BIGINT + 100) AS q1, (o.total::BIGINT * o.q3 + 100 * l.q3) // (o.total::BIGINT + 100) AS q3
  FROM q o JOIN q_lang l ON l.metric = o.metric AND l.lang IS NOT DISTINCT FROM o.lang WHERE o.level = 0),
f AS (SELECT *, CASE WHEN two THEN q1 - 6 * greatest(q3 - q1, spread) ELSE -1 END AS low, q3 + 6 * greatest(q3 - q1, spread) AS high FROM q_own),
bad AS (
  SELECT DISTINCT m.doc_id FROM m
  JOIN f ON f.metric = m.metric AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
  WHERE NOT v BETWEEN low AND high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad)) AS kept
FROM b
"""

OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, length('<|im_start|>' || url_encode(role) || chr(10) || '<|im_end|>' || chr(10))
      + length(regexp_replace(text, '([<\[])(~*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])', '\1~\2\3', 'g')) AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
c AS (SELECT *, sum(w) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap FROM d GROUP BY 1),
k AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, k) AS i FROM k),
l AS (
  SELECT a.*, (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM o) - coalesce((SELECT sum(b.cap) FROM o b WHERE b.i < a.i), 0) AS rest,
    (SELECT sum(b.w) FROM o b WHERE b.i >= a.i) AS weight FROM o a),
f AS (SELECT i AS first_free, rest / weight AS level FROM l WHERE rest / weight * w <= cap ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN i >= first_free THEN level * w ELSE cap END AS target FROM l LEFT JOIN f ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || ':11'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

OP10 = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
m AS (
  SELECT doc_id, i, line, array_to_string(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9@]') THEN '<*>' ELSE w END), ' ') AS mk FROM x),
u AS (SELECT mk, count(DISTINCT doc_id) AS n, string_split(mk, ' ') AS ts FROM m WHERE len(string_split(mk, ' ')) >= 3 GROUP BY mk),
lf AS (SELECT *, len(ts)::VARCHAR || ' ' || array_to_string(ts[1:3], ' ') AS leaf FROM u),
gl AS (SELECT leaf FROM lf GROUP BY leaf HAVING sum(n) >= 3 AND count(*) > 1),
tk AS (SELECT leaf, mk, n, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM lf WHERE leaf IN (SELECT leaf FROM gl)),
sp AS (SELECT leaf, pos, token, sum(n) AS support FROM tk WHERE token <> '<*>' GROUP BY ALL HAVING sum(n) >= 3),
ls AS (
  SELECT mk, list(tk.token ORDER BY tk.pos) AS tokens, list(coalesce(support, 0) ORDER BY tk.pos) AS supports, count(support) AS c, count(*) AS len
  FROM tk LEFT JOIN sp ON tk.leaf = sp.leaf AND tk.pos = sp.pos AND tk.token = sp.token GROUP BY mk),
gn AS (
  SELECT mk, array_to_string(list_transform(range(1, len + 1), lambda j: CASE WHEN supports[j] >= 3 AND supports[j] >= 0.5::DOUBLE * list_reverse_sort(supports)[ceil(0.7::DOUBLE * len)::BIGINT] THEN tokens[j] ELSE '<*>' END), ' ') AS general
  FROM ls WHERE c >= 0.7::DOUBLE * len),
tp AS (SELECT mk, coalesce(general, mk) AS template FROM lf LEFT JOIN gn USING (mk)),
rc AS (SELECT template, min(doc_id) AS first_doc FROM tp JOIN m USING (mk) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
dr AS (SELECT mk, rc.first_doc FROM tp JOIN rc USING (template)),
k AS (SELECT m.doc_id, i, line, (dr.mk IS NOT NULL AND m.doc_id <> dr.first_doc) AS dropped FROM m LEFT JOIN dr ON m.mk = dr.mk)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS text_sha256
FROM k GROUP BY doc_id
"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.d WHERE r.root < e.v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, w.doc_id = m.root AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(root) AS root FROM r GROUP BY 1) m ON m.d = w.doc_id
"""

OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, least(len(ws), 5) AS k, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
bs AS (SELECT DISTINCT item_id, least(len(ws), 5) AS k, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM b WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
p AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS item_shingles, c::BIGINT AS shared_shingles FROM p JOIN n USING (item_id) WHERE 5 * c >= 4 * n
"""

ORACLES = {"op4_decontamination": OP4, "op6_minhash_dedup": OP6, "op2_chat_format": OP2, "op7_quality_rules": OP7, "op9_mixing": OP9, "op10_line_dedup": OP10}
