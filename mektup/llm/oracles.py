"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
m AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM m""",
    "op6_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<\[]', '', 'g')) + 19 AS piece FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(piece)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op12_lexical_search": r"""
WITH t AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
l AS (SELECT row_id, doc_id, len(terms) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM l),
i AS (
  SELECT row_number() OVER () AS item, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS qtf FROM i GROUP BY ALL),
f AS (
  SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM t)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term),
m AS (SELECT row_id, doc_id, 100 - 75 + ((75 * n * big_n) // big_l) AS m FROM l, s),
r AS (
  SELECT item, item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (row_id) GROUP BY item, item_id, row_id, doc_id),
k AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    "op13_structure_repair": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(place, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))),
    4294967295::BIGINT) % 20 AS harm FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE harm WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM d),
f AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
    CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM o),
g AS (
  SELECT conv_id, turn, role, text, i, fault, initial,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f),
a AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM g GROUP BY conv_id),
-- cheapest cost and least audit from each state (none, after s, after u, after a), row by row from the end
e AS (
  SELECT conv_id, n AS i, {'c': 0, 'a': ''} AS z, {'c': 10, 'a': 'II'} AS s, {'c': 5, 'a': 'I'} AS u, {'c': 0, 'a': ''} AS v FROM a
  UNION ALL
  SELECT conv_id, i, least(z0, {'c': u1.c + 5, 'a': 'I' || u1.a}), least(s0, {'c': u1.c + 5, 'a': 'I' || u1.a}), u1, v1
  FROM (
    SELECT *, least(u0, {'c': v0.c + 5, 'a': 'I' || v0.a}) AS u1, least(v0, {'c': u0.c + 5, 'a': 'I' || u0.a}) AS v1
    FROM (
      SELECT conv_id, i,
        least({'c': z.c + 2, 'a': 'D' || z.a}, {'c': y + 1 + u.c, 'a': 'R' || u.a},
          CASE initial WHEN 's' THEN {'c': y + s.c, 'a': 'K' || s.a} WHEN 'u' THEN {'c': y + u.c, 'a': 'K' || u.a} END) AS z0,
        least({'c': s.c + 2, 'a': 'D' || s.a}, {'c': y + 1 + u.c, 'a': 'R' || u.a},
          CASE initial WHEN 'u' THEN {'c': y + u.c, 'a': 'K' || u.a} END) AS s0,
        least({'c': u.c + 2, 'a': 'D' || u.a}, {'c': y + 1 + v.c, 'a': 'R' || v.a},
          CASE initial WHEN 'a' THEN {'c': y + v.c, 'a': 'K' || v.a} END) AS u0,
        least({'c': v.c + 2, 'a': 'D' || v.a}, {'c': y + 1 + u.c, 'a': 'R' || u.a},
          CASE initial WHEN 'u' THEN {'c': y + u.c, 'a': 'K' || u.a} END) AS v0
      FROM (
        SELECT e.conv_id, e.i - 1 AS i, z, s, u, v, initial,
          CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS y
        FROM e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i)))),
b AS (
  SELECT a.conv_id, gaps, blank, duplicate, truncated, illegal, z.c AS cost, z.a AS audit
  FROM a JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id AND e.i = 0),
l AS (
  SELECT conv_id, audit, p, substr(audit, p, 1) AS letter,
    length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS k,
    length(replace(audit, 'D', '')) % 2 AS odd
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM b)),
r AS (
  SELECT l.conv_id, sha256(string_agg(
    CASE WHEN letter = 'K' THEN g.role WHEN (k - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE g.text END, chr(10) ORDER BY p)) AS repaired_sha256
  FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.i = l.i AND letter <> 'I'
  WHERE letter <> 'D' GROUP BY l.conv_id)
SELECT DISTINCT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op11_run_length_dedup": r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(1, n_bytes - 98), lambda p: {'p': p, 's': md5_number(array_slice(b, p, p + 99))}), recursive := true) FROM b),
s AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM w),
g AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM s WHERE again),
i AS (SELECT doc_id, p, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
r AS (SELECT doc_id, span, min(p) AS first, max(p) + 99 AS last FROM i GROUP BY ALL),
k AS (
  SELECT doc_id, first, lag(last, 1, 0::BIGINT) OVER (PARTITION BY doc_id ORDER BY first) + 1 AS begin, last FROM r),
a AS (
  SELECT doc_id, sum(last - first + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(last) AS tail,
    list(struct_pack(begin := begin, stop := first - 1) ORDER BY first) AS kept FROM k GROUP BY doc_id)
SELECT b.doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN tail IS NULL THEN b ELSE unhex(array_to_string(list_transform(list_append(kept, struct_pack(begin := tail + 1, stop := n_bytes)),
    lambda x: CASE WHEN x.stop >= x.begin THEN hex(array_slice(b, x.begin, x.stop)) ELSE '' END), '')) END) AS kept_sha256
FROM b LEFT JOIN a USING (doc_id)""",
}
