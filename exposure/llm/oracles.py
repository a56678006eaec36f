"""SQL that DuckDB runs over the same tables, for the operators that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g FROM bs),
sizes AS (SELECT DISTINCT k FROM win),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT DISTINCT ds.doc_id, ds.s, ds.k, win.item FROM ds JOIN win ON win.k = ds.k AND win.g = array_to_string(list_slice(ds.w, ds.s, ds.s + ds.k - 1), ' ')),
spots AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM hits) x),
n AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

NEAR_GROUPS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, ends.b FROM reach JOIN ends ON ends.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.other) AS component_id, d.doc_id = min(reach.other) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.id = d.doc_id GROUP BY d.doc_id, n.n"""

REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM t WHERE length(h) >= 400) x),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT w.doc_id, w.p, CASE WHEN w.p - lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) <= 200 THEN 0 ELSE 1 END AS fresh FROM w JOIN r USING (k)),
runs AS (SELECT doc_id, run, min(p) AS lo, max(p) + 200 AS hi FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m) x GROUP BY doc_id, run),
gaps AS (SELECT t.doc_id, t.h, runs.lo, runs.hi, coalesce(lag(runs.hi) OVER (PARTITION BY runs.doc_id ORDER BY runs.lo), 0) AS from_ FROM runs JOIN t USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (lo - from_) AS BIGINT)), '' ORDER BY lo) AS head, max(hi) AS hi, sum(hi - lo) AS n, count(*) AS spans FROM gaps GROUP BY doc_id)
SELECT t.doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, coalesce(kept.spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN kept.n IS NULL THEN t.h ELSE concat(kept.head, substr(t.h, CAST(2 * kept.hi + 1 AS BIGINT))) END)) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)"""


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + "))"
#: crc32 of an id as text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
_UP = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(concat(nodes[2 * i + 1], coalesce(nodes[2 * i + 2], ''))))"

MANIFEST = f"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id
  FROM (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} END AS bent FROM documents) x),
up(lang, level, nodes) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM l GROUP BY lang UNION ALL SELECT lang, level + 1, {_UP} FROM up WHERE len(nodes) > 1),
subs AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM up WHERE len(nodes) = 1),
over_(level, nodes) AS (SELECT 0, list(subroot ORDER BY pos) FROM subs UNION ALL SELECT level + 1, {_UP} FROM over_ WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root FROM over_ WHERE len(nodes) = 1),
steps AS (SELECT id, level, l.pos // (1 << level) AS p, nodes FROM l JOIN up ON up.lang IS NOT DISTINCT FROM l.lang AND len(nodes) > 1
  UNION ALL SELECT id, 100 + level, subs.pos // (1 << level), nodes FROM l JOIN subs ON subs.lang IS NOT DISTINCT FROM l.lang JOIN over_ ON len(nodes) > 1),
met AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY level) AS k, p % 2 = 1 AS right_, coalesce(CASE WHEN p % 2 = 1 THEN nodes[CAST(p AS BIGINT)] ELSE nodes[CAST(p AS BIGINT) + 2] END, '') AS other FROM steps),
folds(id, k, node) AS (SELECT id, 0, coalesce(bent, leaf) FROM l UNION ALL
  SELECT met.id, met.k, sha256(CASE WHEN right_ THEN concat(other, node) ELSE concat(node, other) END) FROM folds JOIN met ON met.id = folds.id AND met.k = folds.k + 1),
ends AS (SELECT id, arg_max(node, k) AS folded_root FROM folds GROUP BY id),
proofs AS (SELECT id, string_agg(other, '' ORDER BY k) AS s FROM met GROUP BY id)
SELECT l.doc_id, l.leaf, subs.subroot, root.root, sha256(coalesce(proofs.s, '')) AS proof_sha256, ends.folded_root, ends.folded_root = root.root AS verified
FROM l JOIN subs ON subs.lang IS NOT DISTINCT FROM l.lang JOIN ends USING (id) LEFT JOIN proofs USING (id), root"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS row_,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.row_ AS a, a.vec_id AS anchor_id, b.row_ AS b, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row_ <> b.row_ AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id, s.b) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
