"""What the operators' queries return, in DuckDB SQL, where SQL can say it."""

from . import mixing, quality_rules

_WORDS = r"[^\x20\x09-\x0D]+"

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY 1), n AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.y, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id"""

RULES = f"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
runs AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w), keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM runs),
twice AS (SELECT doc_id, k FROM keyed GROUP BY 1, 2 HAVING count(*) > 1), covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS place FROM keyed JOIN twice USING (doc_id, k)),
rep AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1),
f AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')))))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT} * n_words AS base_failed FROM f),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT)::BIGINT AS bad FROM g GROUP BY 1), prior AS (SELECT sum(bad) / sum(n) AS mean, round(var_pop(bad / n), 12) AS spread FROM hosts),
p AS (SELECT mean, CASE WHEN spread > 0 THEN least({quality_rules.PRIOR[1]}, greatest({quality_rules.PRIOR[0]}, mean * (1 - mean) / spread - 1)) ELSE {quality_rules.PRIOR[1]} END AS weight FROM prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (bad + mean * weight) / (n + weight) <= {quality_rules.MAX_HOST_RATE} AS kept
FROM g JOIN hosts ON hosts.source IS NOT DISTINCT FROM g.source, p"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w) UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 75 * (a.n + b.n - m)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y), low AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low.y, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.x = d.doc_id"""

MIXING = f"""WITH RECURSIVE n AS (SELECT doc_id, source, text, ceil(strlen(coalesce(text, '')) / {mixing.TOKEN_BYTES}.0)::BIGINT AS n_tokens FROM documents),
d AS (SELECT doc_id, source, n_tokens, md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || n_tokens || ':' || md5(coalesce(text, ''))) AS key FROM n), g AS (SELECT source, key, max(n_tokens) AS n, count(*) AS m FROM d GROUP BY 1, 2),
s AS (SELECT source, sum(n * m)::BIGINT AS tokens, sum(m)::BIGINT AS n_rows FROM g GROUP BY 1 HAVING sum(n * m) > 0), r AS (SELECT max(tokens) / min(tokens) AS ratio, sum(tokens) AS total FROM s),
steps(k, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, CASE WHEN ratio ^ (1 - (low + high) / 2) > 4 THEN (low + high) / 2 ELSE low END, CASE WHEN ratio ^ (1 - (low + high) / 2) > 4 THEN high ELSE (low + high) / 2 END FROM steps, r WHERE k < {mixing.STEPS}),
e AS (SELECT CASE WHEN (SELECT ratio FROM r) > 4 THEN (SELECT round(high, 6) FROM steps WHERE k = {mixing.STEPS}) ELSE 0.0 END AS exponent),
w AS (SELECT source, tokens, n_rows, (tokens / total) ^ exponent AS raised FROM s, r, e), t AS (SELECT source, tokens, n_rows, floor(raised * max(tokens / raised) OVER () + 1e-6)::BIGINT AS target FROM w),
sized AS (SELECT source, target // tokens AS passes, target % tokens AS rest, least({mixing.MAX_BLOCKS}, greatest(1, ceil(tokens / {mixing.BLOCK_TOKENS}), ceil(n_rows / {mixing.BLOCK_ROWS})))::BIGINT AS n_blocks FROM t),
b AS (SELECT g.*, passes, rest, ('0x' || substr(key, 1, 8))::BIGINT % coalesce(n_blocks, 1) AS block FROM g LEFT JOIN sized ON sized.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, sum(n * m) OVER (PARTITION BY source ORDER BY block, key ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM b)
SELECT doc_id, d.source, n_tokens, block, (stop - n * m)::BIGINT AS place, coalesce(passes + (stop <= rest)::BIGINT, 1) AS copies FROM d JOIN o ON o.key = d.key AND o.source IS NOT DISTINCT FROM d.source"""

AUDIT = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, good, toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS code FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, code, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2),
o(s) AS (SELECT '' UNION ALL SELECT s || c FROM o JOIN (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) ON NOT contains(s, c)),
k AS (SELECT s, step, 1 << (position(s[step] IN 'ABCDE') - 1) AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (position(s[i] IN 'ABCDE') - 1))), 0)::INT AS before FROM (SELECT s, unnest(range(1, 6)) AS step FROM o WHERE length(s) = 5)),
r AS (SELECT part, s AS filter_order, step::INT AS step, bit, coalesce(sum(n) FILTER (WHERE code & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE code & before = 0 AND code & bit > 0), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (WHERE code & before > 0 AND code & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE code = bit), 0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (WHERE code & before = 0 AND code & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE code & before = 0 AND code & bit > 0), 0)::BIGINT AS toxic_lost FROM g, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r"""

_CRC_STEP = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)"
TRIE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)), lambda a, b: {_CRC_STEP}), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, h, count(t.pos) AS taken FROM c LEFT JOIN t ON t.conv_id = base AND pos <= h GROUP BY 1, 2),
u AS (SELECT c.conv_id, pos AS d, r, x FROM c JOIN t ON t.conv_id = base AND pos <= h UNION ALL SELECT conv_id, taken + pos - h, r, x FROM t JOIN b USING (conv_id) WHERE pos > h),
k AS (SELECT conv_id, d, length(x) AS n_chars, md5(string_agg(length(r) || ':' || r || length(x) || ':' || x, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM u UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS parent, lead(k) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends FROM k),
n AS (SELECT d, k, parent, any_value(n_chars) AS n_chars, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM e GROUP BY 1, 2, 3),
m AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n ch WHERE ch.parent = n.k AND ch.d = n.d + 1) AS n_children FROM n LEFT JOIN n p ON p.k = n.parent AND p.d = n.d - 1),
s AS (SELECT DISTINCT a.d, a.k, z.d AS zd, z.k AS zk FROM k a JOIN k z ON a.conv_id = z.conv_id AND z.d >= a.d),
g AS (SELECT s.d, s.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n_chars)::BIGINT AS saved_tokens FROM s JOIN m ON m.d = zd AND m.k = zk GROUP BY 1, 2)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM m JOIN g USING (d, k)"""

ORACLES = {"op3_embedding_near_dedup": EMBEDDINGS, "op5_quality_rules": RULES, "op8_source_mixing": MIXING, "op9_minhash_near_dedup": NEAR, "op12_prefix_trie": TRIE, "op13_filter_audit": AUDIT}
