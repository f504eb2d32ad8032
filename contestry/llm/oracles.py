"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH dw AS (
  SELECT doc_id, text, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
dgrams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, g.item_id FROM dgrams d JOIN grams g ON d.n = g.n AND d.gram = g.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM p LEFT JOIN firsts ON p.digest = firsts.digest
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
#: Levels up to the root: each step hashes runs of eight nodes of the groups that still have several.
_LEVELS = """
  SELECT g, 0 AS level, pos, size, h FROM {0}
  UNION ALL
  SELECT g, level + 1, pos // 8, (max(size) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {1} WHERE size > 1 GROUP BY g, level, pos // 8"""
_SIDES = """SELECT n.g, n.level, n.pos, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < n.pos), '') AS b,
  coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > n.pos), '') AS a
  FROM {0} n JOIN {0} o ON o.g = n.g AND o.level = n.level AND o.pos // 8 = n.pos // 8 WHERE n.size > 1 GROUP BY n.g, n.level, n.pos"""

OP11 = f"""
WITH RECURSIVE bytes_ AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {_LEAF.format(_FIELD.format('text'))} AS leaf,
  CASE WHEN touched THEN {_LEAF.format("coalesce(strlen(low) || ':' || low, '-')")} ELSE {_LEAF.format(_FIELD.format('text'))} END AS start
  FROM (SELECT *, {_LOWER.format('text')} AS low, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 3 = 0 AS touched FROM documents, bytes_)),
leaves AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size,
  row_number() OVER () AS row FROM d),
inner_ AS ({_LEVELS.format('leaves', 'inner_')}),
subroots AS (SELECT '' AS g, g AS key, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS size FROM inner_ WHERE size = 1),
outer_ AS ({_LEVELS.format('subroots', 'outer_')}),
sides AS ({_SIDES.format('inner_')}),
sides_above AS ({_SIDES.format('outer_')}),
proof AS (
  SELECT row, level, b, a FROM leaves l JOIN sides s ON s.g = l.g AND s.pos = l.pos >> (3 * level)
  UNION ALL
  SELECT row, 1000 + level, b, a FROM leaves l JOIN subroots r ON r.key = l.g JOIN sides_above s ON s.pos = r.pos >> (3 * level)),
proofs AS (SELECT row, string_agg(b || a, '' ORDER BY level) AS all_, list({{'b': b, 'a': a}} ORDER BY level) AS path FROM proof GROUP BY row),
folded AS (SELECT l.*, coalesce(all_, '') AS all_, list_reduce(list_prepend({{'b': start, 'a': ''}}, coalesce(path, [])), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root
  FROM leaves l LEFT JOIN proofs USING (row))
SELECT doc_id, leaf, r.h AS subroot, o.h AS root, sha256(all_) AS proof_sha256, folded_root, folded_root = o.h AS verified
FROM folded f JOIN subroots r ON r.key = f.g CROSS JOIN (SELECT h FROM outer_ WHERE size = 1) o
"""

_DRAW = "CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {0}, 8) AS BIGINT)"

OP12 = rf"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, {', '.join(f'{_DRAW.format(8 * k + 1)} AS h{k + 1}' for k in range(4))}
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

ORACLE_SQL = {"op10_warc": OP10, "op11_merkle": OP11, "op12_fim": OP12, "op1_decontamination": OP1}
