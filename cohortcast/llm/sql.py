"""Checking SQL (DuckDB) for the operators that SQL can express."""

from __future__ import annotations

_PII_KINDS = (
    # name, rank, pattern, test of the hit h, points of a confirmed hit, context pattern, least points
    ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 80, "mail|contact|write to", 1),
    ("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
     r"regexp_full_match(h, '0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}')",
     60, r"\bip\b|address|host|server", 1),
    ("card", 2, r"[0-9](?:[ -]?[0-9])+",
     "len(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len(digits) + 1), "
     "lambda k: CASE WHEN k % 2 = 1 THEN digits[len(digits) + 1 - k]::INT "
     "ELSE (digits[len(digits) + 1 - k]::INT * 2) // 10 + (digits[len(digits) + 1 - k]::INT * 2) % 10 END)) % 10 = 0",
     80, "card|visa|master|credit|pay", 1),
    ("phone", 3, r"\+[0-9][ ().0-9-]+[0-9]", "len(digits) BETWEEN 10 AND 15", 60, "phone|tel|call|mobile", 1),
    ("iban", 4, r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}",
     "len(code) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform("
     "range(1, len(code) + 1), lambda k: ascii((code[5:] || code[1:4])[k]))), "
     "lambda r, c: CASE WHEN c >= 65 THEN (r * 100 + c - 55) % 97 ELSE (r * 10 + c - 48) % 97 END) = 1",
     80, "iban|account|bank", 60),
    ("ssn", 5, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(h, '^(000|666|9)|-00-|-0000$')", 40,
     r"\bssn\b|social security", 60),
)


def _pii_branch(name, rank, pattern, test, points, context, least) -> str:
    return f"""
SELECT doc_id, {rank} AS rank, '{name}' AS kind, start, start + length(h) AS stop
FROM (
  SELECT doc_id, h, regexp_replace(h, '[^0-9]', '', 'g') AS digits, replace(h, ' ', '') AS code,
    coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) AS start,
    right(gaps[i], 40) || ' ' || left(gaps[i + 1], 40) AS near
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS h FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps
    FROM texts)))
WHERE ({test}) AND {points} + CASE WHEN regexp_matches(near, '(?i){context}') THEN 20 ELSE 0 END >= {least}"""


_SPANS = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"

PII = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_pii_branch(*k) for k in _PII_KINDS)}),
per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    coalesce({_SPANS} FILTER (rank < 4), '') AS base, {_SPANS} AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = f"""
WITH lines AS (
  SELECT doc_id, line, no, trim({_LOWER.format('line')}, {_SPACE}) AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS no
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
repeated AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (r.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN repeated r USING (key) GROUP BY doc_id
"""

_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

PASSAGES = f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
tests AS (SELECT item_id, {_WORDS} AS w, least(10, len({_WORDS})) AS size FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS passage
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM tests WHERE size > 0)),
parts AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS passage
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, i, p.size, item_id FROM parts p JOIN windows v ON p.passage = v.passage AND p.size = v.size),
hits AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN names m USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 90 * (x.n + y.n - s.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""

VECTORS = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
units AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM valid),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a),
tops AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(t.b, vec_id)) AS component_id,
  least(vec_id, coalesce(t.b, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN degrees d ON d.a = vec_id LEFT JOIN tops t ON t.a = vec_id
"""

TRIE = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, list(struct_pack(r := r, x := x) ORDER BY pos) AS own,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda s, step: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295) % 9 AS h
  FROM turns GROUP BY c),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS v
  FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 5),
prefixes AS (SELECT c, d, v[1:d] AS k, len(v) = d AS ends FROM (SELECT *, unnest(range(len(v) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].x) END AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, k),
kids AS (SELECT a.d, a.k, count(b.k) AS n FROM nodes a LEFT JOIN nodes b ON b.d = a.d + 1 AND b.k[1:a.d] = a.k GROUP BY a.d, a.k),
sums AS (
  SELECT a.d, a.k, sum(b.saved) AS saved, count(*) FILTER (c.n = 0) AS leaves
  FROM nodes a JOIN nodes b ON b.d >= a.d AND b.k[1:a.d] = a.k JOIN kids c ON c.d = b.d AND c.k = b.k GROUP BY a.d, a.k)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, kids.n AS n_children, sums.leaves AS n_leaves,
  sums.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN kids ON kids.d = n.d AND kids.k = n.k JOIN sums ON sums.d = n.d AND sums.k = n.k
LEFT JOIN nodes p ON p.d = n.d - 1 AND n.k[1:p.d] = p.k
"""

MIX = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':13') AS key FROM documents),
ordered AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM rows),
named AS (
  SELECT source, size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, sum(size) AS size FROM rows GROUP BY source)),
levels AS (
  SELECT max((1.5::DOUBLE * s - 2.0::DOUBLE * bs) / (w - bw)) AS level FROM (
    SELECT sum(size) OVER () AS s, sum(weight) OVER () AS w, sum(size) OVER o - size AS bs, sum(weight) OVER o - weight AS bw
    FROM named WINDOW o AS (ORDER BY (size * 2.0::DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING))),
targets AS (SELECT source, size AS source_size, least(size * 2.0::DOUBLE, weight * level) AS target FROM named, levels),
budgets AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size::BIGINT ELSE 0 END AS epochs FROM targets)
SELECT doc_id, o.source, size, source_size::BIGINT AS source_size, target,
  (b.epochs * size + greatest(0, least(size, budget - b.epochs * source_size - before)))::BIGINT AS taken,
  (b.epochs + CASE WHEN least(size, budget - b.epochs * source_size - before) > 0 THEN 1 ELSE 0 END)::BIGINT AS epochs,
  least(size, budget - b.epochs * source_size - before) > 0 AND least(size, budget - b.epochs * source_size - before) < size AS cut
FROM ordered o JOIN budgets b ON o.source IS NOT DISTINCT FROM b.source
"""
