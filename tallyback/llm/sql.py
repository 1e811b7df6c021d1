"""DuckDB statements for the corpus queries that SQL can express, over views named like the tables."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, pos, substr(h, 2 * pos + 1, 200) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS pos FROM d)
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1
), marked AS (
  SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS new FROM later
), numbered AS (
  SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked
), runs AS (
  SELECT doc_id, run, min(pos) AS s, max(pos) + 100 AS e FROM numbered GROUP BY ALL
), cuts AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS from_here FROM runs
), heads AS (
  SELECT c.doc_id, string_agg(substr(d.h, 2 * from_here + 1, 2 * (s - from_here)), '' ORDER BY s) AS kept, max(e) AS tail,
         sum(e - s) AS n_removed, count(*) AS n_spans
  FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN heads USING (doc_id)
"""

# Sources, their targets and every document's place in the queue of its source.
_MIX = r"""
sized AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {docs}
), s AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), steps AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0)) * 1.0::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size * 3.0::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT level FROM steps WHERE source_size * 3.0::DOUBLE >= weight * level ORDER BY source_size * 3.0::DOUBLE / weight, rank LIMIT 1
), targets AS (
  SELECT source, rank, source_size, least(source_size * 3.0::DOUBLE, weight * (SELECT level FROM filled)) AS target FROM s
), queued AS (
  SELECT doc_id, text, rank, source_size, target, size, md5(CAST(doc_id AS VARCHAR)) AS shuffle,
         sum(size) OVER (PARTITION BY rank ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS ends
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source WHERE size > 0
), entries AS (
  SELECT *, (lap * source_size + ends) / target AS finish FROM queued, (SELECT unnest([0, 1, 2]) AS lap)
), mixed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, lap, shuffle, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM entries
), copies AS (
  SELECT doc_id, count(*) AS copies FROM mixed WHERE used <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)"""

OP6 = "WITH " + _MIX.replace("{docs}", "documents") + """
SELECT doc_id, size, source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken
FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source LEFT JOIN copies USING (doc_id)
"""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sets of 5-word shingles and the components of links at a Jaccard similarity of 0.8, over {docs}.
_NEAR = r"""
lists AS (
  SELECT doc_id, {words} AS w FROM {docs}
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM lists
), sets AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sets sa ON sa.doc_id = a.doc_id JOIN sets sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, sa.n, sb.n HAVING 100 * count(*) >= 80 * (sa.n + sb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM {docs} UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), roots AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)""".replace("{words}", _WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"))

OP2 = "WITH RECURSIVE " + _NEAR.replace("{docs}", "documents") + """
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM roots LEFT JOIN sets USING (doc_id)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, {words} AS w FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 35], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 34, 0))) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS k FROM v) WHERE k > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM again
), each AS (
  SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""".replace("{words}", _WORDS.format("coalesce(text, '')"))

OP3 = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents
), k AS (
  SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l
), wide AS (
  SELECT bare FROM k WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 5
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM k ANTI JOIN wide USING (bare) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.n, 0) - coalesce(kept.n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN lines USING (doc_id)
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), lasts AS (
  SELECT conv_id, max(turn) FILTER (role = 'assistant') AS turn, arg_max(text, turn) FILTER (role = 'assistant') AS text FROM t GROUP BY conv_id
), swaps AS (
  SELECT conv_id, turn, coalesce(lead(text) OVER (ORDER BY conv_id), CASE WHEN lead(conv_id) OVER (ORDER BY conv_id) IS NULL
         THEN first_value(text) OVER (ORDER BY conv_id) END) AS other FROM lasts
), sides AS (
  SELECT 'chosen' AS side, conv_id, turn, role, text FROM t
  UNION ALL
  SELECT 'rejected', t.conv_id, t.turn, t.role, CASE WHEN t.turn = s.turn AND t.role = 'assistant' AND other IS NOT NULL THEN other ELSE t.text END
  FROM t JOIN swaps s ON t.conv_id = s.conv_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn, role, text) AS i,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM sides
), common AS (
  SELECT c.conv_id, coalesce(min(c.i) FILTER (c.role <> r.role OR c.text <> r.text) - 1, count(*)) AS n_common
  FROM placed c JOIN placed r ON c.side = 'chosen' AND r.side = 'rejected' AND c.conv_id = r.conv_id AND c.i = r.i GROUP BY c.conv_id
), done AS (
  SELECT p.*, n_common, sum(length(shown)) OVER (PARTITION BY side, p.conv_id ORDER BY i) - length(shown) + length(role) + 5 AS s
  FROM placed p JOIN common USING (conv_id) WHERE i > n_common
), ends AS (
  SELECT side, conv_id, string_agg(shown, '' ORDER BY i) AS text,
         string_agg(CAST(s AS BIGINT) || '-' || CAST(s + length(done.text) + 7 AS BIGINT), ',' ORDER BY i) FILTER (role = 'assistant') AS spans
  FROM done GROUP BY side, conv_id
), prompts AS (
  SELECT conv_id, string_agg(shown, '' ORDER BY i) AS prompt FROM placed JOIN common USING (conv_id) WHERE side = 'chosen' AND i <= n_common GROUP BY conv_id
)
SELECT common.conv_id AS pair_id, CAST(n_common AS BIGINT) AS n_common, coalesce(prompt, '') AS prompt, coalesce(c.text, '') AS chosen,
       coalesce(r.text, '') AS rejected, coalesce(c.spans, '') AS chosen_spans, coalesce(r.spans, '') AS rejected_spans
FROM common LEFT JOIN prompts USING (conv_id) LEFT JOIN ends c ON c.conv_id = common.conv_id AND c.side = 'chosen'
LEFT JOIN ends r ON r.conv_id = common.conv_id AND r.side = 'rejected'
"""

OP12 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""

# crc32 from its rule: a table of 256 remainders, then one step per byte of the UTF-8 text.
OP13 = """
WITH RECURSIVE remainders AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS g(i))
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [(192 + (unicode(ch) >> 6))::BIGINT, (128 + (unicode(ch) & 63))::BIGINT] END)) AS b
  FROM runs WHERE length(run) >= 6
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, remainders
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON f.word = e.word
"""
