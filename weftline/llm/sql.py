"""The queries that SQL can express, as SQL for an in-process database."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + k - 1) AS x, k
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT p.doc_id, p.i, p.k, v.item_id FROM (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS x FROM places) p JOIN windows v ON v.k = p.k AND v.x = p.x),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = rf"""
WITH l AS (SELECT doc_id, i, list[i] AS line, {_LOWER.format("trim(list[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT doc_id, list, unnest(range(1, len(list) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents))),
shared AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN shared USING (k) GROUP BY doc_id
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes k ON k.doc_id = b.doc_id
  GROUP BY u, v, m.n, k.n HAVING 100 * count(*) >= 90 * (m.n + k.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS r FROM d UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT u AS doc_id, min(r) AS component_id FROM reach GROUP BY u) USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
latest AS (SELECT body, max(page_id) AS page FROM p WHERE payload_bytes >= 1000 GROUP BY body)
SELECT page_id, payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN page <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page <> page_id THEN page END AS refers_to
FROM p LEFT JOIN latest USING (body)
"""

#: CRC-32 of a short text of ASCII, bit by bit (fixed polynomial).
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"
)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, leaves: str) -> str:
    """Levels of a tree: (g, lvl, pos, h, n), n the nodes of that level."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, pos, h, n FROM {leaves} UNION ALL
  SELECT g, lvl + 1, pos // 2, sha256(h || coalesce(other, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY pos) AS other FROM {name} WHERE n > 1) WHERE pos % 2 = 0)"""


OP12 = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang AS g, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS changed,
    {_CRC32.format("doc_id::VARCHAR")} % 7 = 0 AS hurt,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
leaves AS (SELECT g, pos, leaf AS h, n FROM rows),
{_tree("tree", "leaves")},
tops AS (SELECT 0 AS g, g AS lang, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n FROM tree WHERE n = 1),
{_tree("crown", "tops")},
levels AS (SELECT DISTINCT g, lvl FROM tree WHERE n > 1),
steps AS (
  SELECT r.doc_id, l.lvl, (r.pos >> l.lvl) % 2 AS side, t.h
  FROM rows r JOIN levels l ON l.g IS NOT DISTINCT FROM r.g
  LEFT JOIN tree t ON t.g IS NOT DISTINCT FROM r.g AND t.lvl = l.lvl AND t.n > 1 AND t.pos = xor(r.pos >> l.lvl, 1)
  UNION ALL
  SELECT r.doc_id, 1000 + l.lvl, (o.pos >> l.lvl) % 2, t.h
  FROM rows r JOIN tops o ON o.lang IS NOT DISTINCT FROM r.g CROSS JOIN (SELECT DISTINCT lvl FROM crown WHERE n > 1) l
  LEFT JOIN crown t ON t.lvl = l.lvl AND t.n > 1 AND t.pos = xor(o.pos >> l.lvl, 1)),
paths AS (
  SELECT doc_id, string_agg(h, '' ORDER BY lvl) AS siblings,
    list(CASE WHEN h IS NULL THEN '-' WHEN side = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY lvl) AS path
  FROM steps GROUP BY doc_id)
SELECT *, folded_root = root AS verified FROM (
SELECT r.doc_id, leaf, o.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN hurt THEN coalesce(changed, leaf) ELSE leaf END, coalesce(path, [])),
    lambda v, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || v) WHEN 'R' THEN sha256(v || s[2:]) ELSE sha256(v) END) AS folded_root
FROM rows r JOIN tops o ON o.lang IS NOT DISTINCT FROM r.g LEFT JOIN paths USING (doc_id))
"""
