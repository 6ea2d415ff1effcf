"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w WHERE len(w) >= 20),
seqs AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS h FROM starts),
later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM seqs) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

LOWER_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
)

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(15 + 2 * length(role) - length(regexp_replace(role, '[\\<#:]', '', 'g')) + 2 * length(text) - length(regexp_replace(text, '[\\<#]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS sh FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
    ('0x' || substr(md5('42:pareto:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
),
r AS (
  SELECT *, 3.0::DOUBLE * source_size AS room, sum(source_size::DOUBLE) OVER () AS total,
    coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS others
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
f AS (SELECT *, room * others <= w * (total - used) AS stop FROM r),
t AS (
  SELECT source, source_size, CASE WHEN stop THEN room ELSE
    w * (total - sum(CASE WHEN stop THEN room ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN stop THEN 0 ELSE w END) OVER (), 0) END AS target
  FROM f
),
c AS (
  SELECT doc_id, size, source_size, target, d.source, u, floor(target / nullif(source_size, 0)) AS whole,
    target / nullif(source_size, 0) - floor(target / nullif(source_size, 0)) AS p
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
k AS (SELECT *, u / (1 - u) * (1 - p) / p AS odds FROM c WHERE p > 0),
m AS (
  SELECT doc_id, coalesce(sum(size) OVER (PARTITION BY source ORDER BY floor(odds / (1 + odds) * 281474976710656.0::DOUBLE), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 <= target - whole * source_size AS more FROM k
)
SELECT c.doc_id, size, source_size, target, (size * (coalesce(whole, 0) + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN m ON c.doc_id = m.doc_id
"""

OP10 = f"""
WITH w AS (SELECT 0 AS kind, doc_id AS id, {LOWER_WORDS} AS w FROM documents UNION ALL SELECT 1, item_id, {LOWER_WORDS} FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE kind = 1 AND len(w) > 0),
s AS (
  SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS sh
  FROM w JOIN k ON kind = 0 OR k = least(len(w), 5)
),
n AS (SELECT id AS item_id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n)::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM s d JOIN s i ON d.sh = i.sh AND d.k = i.k AND d.kind = 0 AND i.kind = 1 JOIN n ON n.item_id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(n)
"""

OP7 = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
),
shared AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, i, line, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
f AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    doc_id > min(doc_id) OVER (PARTITION BY t) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels USING (doc_id)
),
rows AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS failed, count(*)::BIGINT AS n FROM f GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)
),
steps AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5),
seen AS (
  SELECT part, filter_order, step::INTEGER AS step, good, toxic, n, len(failed) AS fails, list_contains(failed, filter_order[step]) AS own,
    len(list_filter(failed, lambda x: contains(left(filter_order, (step - 1)::INTEGER), x))) > 0 AS earlier FROM rows, steps
),
counts AS (
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (WHERE NOT own AND NOT earlier), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE own AND earlier), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE own AND fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE own AND NOT earlier AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (WHERE own AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counts
"""

CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::BIGINT)), lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))
  ), 4294967295::BIGINT)"""

OP12 = f"""
WITH t AS (
  SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key, length(coalesce(text, ''))::BIGINT AS chars, turn
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT conv_id, list({{'k': turn_key, 'n': chars}} ORDER BY turn NULLS FIRST, turn_key) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, {CRC32} % 6 AS h FROM c),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1 : h.h], []), h.turns[h.h + 1 :]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100
),
p AS (
  SELECT conv_id, d, len(turns) AS size, md5(array_to_string(list_transform(turns[1 : d], lambda x: x.k), ',')) AS path,
    md5(array_to_string(list_transform(turns[1 : d - 1], lambda x: x.k), ',')) AS above, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS chars
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)
),
n AS (
  SELECT d, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256 FROM p GROUP BY d, path
),
kids AS (SELECT d - 1 AS d, above AS path, count(*)::BIGINT AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, path)),
below AS (
  SELECT p.d, p.path, count(*) FILTER (WHERE m.n_children = 0)::BIGINT AS n_leaves, sum((m.n_convs - 1) * m.chars)::BIGINT AS saved_tokens
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY ALL
)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN below USING (d, path) LEFT JOIN n u ON u.d = m.d - 1 AND u.path = m.above
"""

OP13 = fr"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
runs AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS s, w FROM w WHERE len(w) >= 5),
keyed AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 4], ' ')) AS h FROM runs),
twice AS (SELECT doc_id, s FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + 5)) AS i FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words OR 100 * n_upper > 30 * word_chars
    OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)) AS kept
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": OP2, "op3_top_scores": OP3, "op4_chat_format": OP4, "op6_minhash_dedup": OP6, "op7_line_dedup": OP7,
        "op8_mix_sources": OP8, "op10_decontaminate": OP10, "op11_filter_audit": OP11, "op12_prefix_trie": OP12, "op13_quality_rules": OP13,
    }
