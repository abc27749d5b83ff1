"""DuckDB SQL of the queries that SQL can express on whole tables."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_schema_fingerprint_chats"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), agg AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
    sum(length('<turn role="' || role || '">' || chr(10) || regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g') || '</turn>' || chr(10))) AS chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars
FROM agg
"""

ORACLE_SQL["op5_positional_index_contamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase, w[i] AS head
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), heads AS (SELECT DISTINCT n, head FROM windows),
tokens AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM tokens JOIN heads ON word = head AND i + n - 1 <= len(w)
), hits AS (SELECT doc_id, i, p.n, item_id, p.phrase FROM places p JOIN windows x ON x.phrase = p.phrase AND x.n = p.n),
hit_words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
), parts AS (
  SELECT phrase, n, off, ws[off + 1] AS term, ws[off + 2] AS after FROM (
    SELECT phrase, n, string_split(phrase, ' ') AS ws, unnest(range(0, n - 1)) AS off FROM (SELECT DISTINCT phrase, n FROM windows)) t
), pairs AS (SELECT DISTINCT term, after FROM parts),
posted AS (
  SELECT a.doc_id, a.i, a.word AS term, b.word AS after FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.i = a.i + 1
  JOIN pairs p ON p.term = a.word AND p.after = b.word
), df AS (SELECT term, after, count(*) AS df FROM posted GROUP BY ALL),
anchors AS (
  SELECT phrase, n, arg_min({'term': term, 'after': after}, (df, off)) AS pair FROM parts LEFT JOIN df USING (term, after)
  GROUP BY phrase, n HAVING min(coalesce(df, 0)) > 0
), at_anchor AS (SELECT doc_id, i AS at, phrase, n FROM posted JOIN anchors ON term = pair.term AND after = pair.after),
spots AS (SELECT doc_id, i AS p, term FROM posted UNION SELECT doc_id, i + 1, after FROM posted),
terms AS (SELECT DISTINCT phrase, unnest(string_split(phrase, ' ')) AS term FROM windows),
n_terms AS (SELECT phrase, count(*) AS n_terms FROM terms GROUP BY phrase),
near AS (
  SELECT a.doc_id, a.phrase FROM at_anchor a JOIN terms t USING (phrase) JOIN n_terms x USING (phrase)
  JOIN spots k ON k.doc_id = a.doc_id AND k.term = t.term AND abs(k.p - a.at) <= a.n - 1 + 2
  GROUP BY a.doc_id, a.phrase, a.at, x.n_terms HAVING count(DISTINCT t.term) = x.n_terms
), near_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM near JOIN windows USING (phrase) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""

ORACLE_SQL["op3_vertical_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s FROM d
), named AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS v, s FROM sets),
reps AS (SELECT v, any_value(n) AS n, min(doc_id) AS rep, any_value(s) AS s FROM named WHERE n > 0 GROUP BY v),
grams AS (SELECT v, n, unnest(s) AS g FROM reps),
common AS (
  SELECT a.v AS a, b.v AS b, a.n AS na, b.n AS nb, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.v < b.v
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL
), links AS (SELECT a, b FROM common WHERE 100 * k >= 90 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT v AS a, v AS b FROM reps UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS v, min(rep) AS component_id FROM reach JOIN reps ON reps.v = reach.b GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id
FROM named LEFT JOIN comp USING (v)
"""

ORACLE_SQL["op8_extendible_hash_shards"] = r"""
WITH r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS bits FROM documents
), at_depth AS (SELECT doc_id, n_bytes, bits, depth, bits >> (60 - depth) AS prefix FROM r, range(0, 31) t(depth) WHERE n_bytes <= 1048576),
sums AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes FROM at_depth GROUP BY ALL),
best AS (
  SELECT doc_id, n_bytes, min_by({'depth': a.depth, 'prefix': a.prefix, 'shard_bytes': shard_bytes}, a.depth) AS b
  FROM at_depth a JOIN sums s ON a.depth = s.depth AND a.prefix = s.prefix WHERE shard_bytes <= 1048576 GROUP BY doc_id, n_bytes
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(b.depth AS INTEGER) AS depth, b.prefix AS prefix, CAST(0 AS BIGINT) AS part,
  CAST(b.shard_bytes AS BIGINT) AS shard_bytes FROM best
UNION ALL SELECT doc_id, CAST(n_bytes AS BIGINT), 60, bits, 0, CAST(n_bytes AS BIGINT) FROM r WHERE n_bytes > 1048576
"""

ORACLE_SQL["op11_bond_hard_negatives"] = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE_SQL["op13_incremental_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars, row_number() OVER () AS no,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), crc AS (
  SELECT no, CAST(doc_id AS VARCHAR) AS s, 0 AS k, 4294967295 AS c FROM d WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT no, s, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT no, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE k < 8 * length(s))
), tampered AS (SELECT no FROM crc WHERE k = 8 * length(s) AND xor(c, 4294967295) % 7 = 0),
leaves AS (
  SELECT doc_id, lang, leaf, coalesce(claimed, leaf) AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS i FROM (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
      CASE WHEN t.no IS NOT NULL THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || tail) END AS claimed
    FROM d LEFT JOIN tampered t USING (no))
), tree AS (
  SELECT lang, 0 AS l, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY lang, l, i // 2
), subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS l, j AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY l, i // 2
), low_steps AS (
  SELECT a.lang, a.i, t.l, (a.i >> t.l) & 1 AS is_right, s.h FROM leaves a JOIN (SELECT DISTINCT lang, l FROM tree WHERE n > 1) t ON a.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM a.lang AND s.l = t.l AND s.i = xor(a.i >> t.l, 1)
), top_steps AS (
  SELECT lang, t.l, (j >> t.l) & 1 AS is_right, s.h FROM subroots JOIN (SELECT DISTINCT l FROM top WHERE n > 1) t ON true
  LEFT JOIN top s ON s.l = t.l AND s.i = xor(j >> t.l, 1)
), steps AS (
  SELECT lang, i, list({'r': is_right, 'h': h} ORDER BY l) AS p FROM (
    SELECT lang, i, l, is_right, h FROM low_steps
    UNION ALL SELECT a.lang, a.i, 1000 + t.l, t.is_right, t.h FROM leaves a JOIN top_steps t ON a.lang IS NOT DISTINCT FROM t.lang) GROUP BY lang, i
), paths AS (
  SELECT a.*, coalesce(p, []) AS p FROM leaves a LEFT JOIN steps s ON a.lang IS NOT DISTINCT FROM s.lang AND a.i = s.i
), folded AS (
  SELECT lang, i, p, 1 AS k, claimed AS h FROM paths
  UNION ALL
  SELECT lang, i, p, k + 1, sha256(CASE WHEN p[k].h IS NULL THEN h WHEN p[k].r = 1 THEN p[k].h || h ELSE h || p[k].h END) FROM folded WHERE k <= len(p)
)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root,
  sha256(coalesce(array_to_string(list_filter(list_transform(a.p, lambda x: x.h), lambda x: x IS NOT NULL), ''), '')) AS proof_sha256,
  f.h AS folded_root, f.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM paths a JOIN folded f ON a.lang IS NOT DISTINCT FROM f.lang AND a.i = f.i AND f.k = len(f.p) + 1 JOIN subroots s ON a.lang IS NOT DISTINCT FROM s.lang
"""
