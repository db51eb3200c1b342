"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
                               ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE list_dot_product(p.e, q.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(q.e, q.e))) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT t.vec_id, least(t.vec_id, coalesce(m.m, t.vec_id)) AS component_id
      FROM embeddings t LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = t.vec_id)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = c.vec_id
"""

OP2 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS x
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM k) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT p.doc_id, p.i, p.word,
             coalesce(max(CASE WHEN f.i IS NOT NULL THEN 1 ELSE 0 END) OVER (
               PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.i)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN (
  SELECT doc_id, sum(gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
  FROM g GROUP BY doc_id) s ON s.doc_id = w.doc_id
"""

OP10 = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_digest,
             CASE WHEN strlen(p) >= 100 THEN min(page_id) OVER (PARTITION BY p) ELSE page_id END AS first
      FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""

# CRC-32, bit by bit: each byte enters at the first of its eight steps; 3988292384 is its reflected polynomial
_CRC32 = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform("
          "regexp_extract_all(hex(encode({})), '..'), lambda x: [('0x' || x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
          "lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)))")


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', 'n_chars']))} || {_field(text)})"


OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, {_leaf('text')} AS leaf,
         CASE WHEN {_CRC32.format('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS chk
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, leaf, chk) - 1 AS pos FROM d),
low AS (
  SELECT 0 AS k, key, pos AS i, leaf AS h FROM p
  UNION ALL
  SELECT any_value(k) + 1, key, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM low) WHERE n > 1 GROUP BY key, i // 3),
tops AS (SELECT key, max(k) AS k FROM low GROUP BY key),
subs AS (SELECT key, low.h, row_number() OVER (ORDER BY key) - 1 AS pos FROM tops JOIN low USING (key, k)),
high AS (
  SELECT 0 AS k, pos AS i, h FROM subs
  UNION ALL
  SELECT any_value(k) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY i // 3),
segs AS (
  SELECT p.key, p.doc_id, p.pos, s.k, string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i < o.i) AS l,
         string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i > o.i) AS r
  FROM p JOIN low o ON o.key = p.key AND o.i = p.pos // CAST(pow(3, o.k) AS BIGINT)
  JOIN low s ON s.key = o.key AND s.k = o.k AND s.i // 3 = o.i // 3
  JOIN tops ON tops.key = o.key AND o.k < tops.k
  GROUP BY p.key, p.doc_id, p.pos, s.k
  UNION ALL
  SELECT p.key, p.doc_id, p.pos, 1000 + s.k, string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i < o.i),
         string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i > o.i)
  FROM p JOIN subs ON subs.key = p.key JOIN high o ON o.i = subs.pos // CAST(pow(3, o.k) AS BIGINT)
  JOIN high s ON s.k = o.k AND s.i // 3 = o.i // 3
  WHERE o.k < (SELECT max(k) FROM high)
  GROUP BY p.key, p.doc_id, p.pos, s.k),
steps AS (SELECT *, row_number() OVER (PARTITION BY key, pos ORDER BY k) AS step FROM segs),
folds AS (
  SELECT key, pos, 1 AS step, chk AS h FROM p
  UNION ALL
  SELECT f.key, f.pos, f.step + 1, sha256(coalesce(l, '') || f.h || coalesce(r, ''))
  FROM folds f JOIN steps s ON s.key = f.key AND s.pos = f.pos AND s.step = f.step),
ends AS (SELECT key, pos, arg_max(h, step) AS folded FROM folds GROUP BY key, pos),
proofs AS (SELECT key, pos, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY step)) AS proof FROM steps GROUP BY key, pos),
top AS (SELECT h AS root FROM high ORDER BY k DESC LIMIT 1)
SELECT p.doc_id, p.leaf, subs.h AS subroot, top.root, coalesce(proofs.proof, sha256('')) AS proof_sha256,
       ends.folded AS folded_root, ends.folded = top.root AS verified
FROM p JOIN subs USING (key) JOIN ends ON ends.key = p.key AND ends.pos = p.pos
LEFT JOIN proofs ON proofs.key = p.key AND proofs.pos = p.pos CROSS JOIN top
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH f AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
g AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS (SELECT w, {_CRC32.format('w')} % 10000 AS b FROM (SELECT w FROM f UNION SELECT w FROM g)),
c AS (SELECT doc_id, b, count(*) AS n FROM f JOIN v USING (w) GROUP BY 1, 2),
s AS (SELECT b, sum(n) AS s FROM c GROUP BY b),
t AS (SELECT b, count(*) AS t FROM g JOIN v USING (w) GROUP BY b),
z AS (SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) AS ss, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) AS tt),
gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain
         FROM s LEFT JOIN t ON s.b = t.b CROSS JOIN z),
q AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM c JOIN gain USING (b) GROUP BY doc_id),
x AS (SELECT d.doc_id, coalesce(n, 0) AS n_features,
             CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
             ('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT AS h
      FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS usable FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN place <= 10 * usable // 100 THEN place END AS rank
FROM y LEFT JOIN o ON o.doc_id = y.doc_id
"""
