"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from weftmine.llm.licenses import PHRASES, TEMPLATES, parsed

OP1 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 2 * source_size AS lim,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS BIGINT) AS weight
  FROM totals
), levels AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT step + 1, new FROM (
    SELECT step, level, (SELECT (1.5::DOUBLE * sum(source_size)::DOUBLE - coalesce(sum(lim) FILTER (lim <= weight * level), 0)::DOUBLE)
                  / (sum(weight) FILTER (lim > weight * level))::DOUBLE FROM ranked) AS new FROM levels)
  WHERE new > level
), plan AS (
  SELECT source, source_size, round(least(lim::DOUBLE, weight * (SELECT max(level) FROM levels)), 6) AS target FROM ranked
), expected AS (
  SELECT s.doc_id, s.size, p.source, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN CAST(floor(p.target / p.source_size * 16777216) AS BIGINT) ELSE 0 END AS e,
         CAST(concat('0x', substr(md5(concat('42:', coalesce(p.source, ''))), 1, 6)) AS BIGINT) AS o
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), summed AS (
  SELECT *, CAST(sum(e) OVER (PARTITION BY source ORDER BY size DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM expected
)
SELECT doc_id, size, source_size, target, CAST(size * (((upto + o) >> 24) - ((upto - e + o) >> 24)) AS BIGINT) AS taken FROM summed
"""

OP10 = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches('.' || host, '\.(ads|adult|casino|cheap|free|spam)-') OR contains('.' || host, '.ads.') THEN 'block'
    WHEN starts_with(path, '/ads/') OR regexp_matches(path, '^/.*/ads/', 's') OR regexp_matches(path, '^/.*\.(exe|zip)$', 's') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w
), one AS (
  SELECT s, min(doc_id) AS id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), parts AS (
  SELECT id, n, unnest(s) AS g FROM one
), linked AS (
  SELECT a, b FROM (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS m FROM parts x JOIN parts y ON x.g = y.g AND x.id <> y.id GROUP BY ALL) WHERE 100 * m >= 85 * (na + nb - m)
), reach AS (
  SELECT id, id AS other FROM one UNION SELECT reach.id, b FROM reach JOIN linked ON other = a
)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM sets LEFT JOIN (SELECT one.s, min(other) AS c FROM one JOIN reach USING (id) GROUP BY one.s) r ON list_sort(sets.s) = r.s AND len(sets.s) > 0
"""

OP9 = """
WITH usable AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 10
"""


def _pattern(part) -> str:
    """The regular expression of a template's part over words with a space after each."""
    if isinstance(part, str):
        return f"{part} "
    return f"(?:[^ ]+ ){{0,{part[1]}}}" if part[0] == "var" else f"(?:{''.join(map(_pattern, part[1]))})?"


#: CRC-32 by a table of 256 remainders, each of eight steps.
OP11 = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc
), turns AS (
  SELECT conv_id, digest, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS p FROM (
    SELECT conv_id, turn, length(coalesce(text, '')) AS n, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations)
), rebuilt AS (
  SELECT i.conv_id, t.p, t.digest, t.n FROM ids i JOIN turns t ON t.conv_id = i.base AND t.p <= i.h
  UNION ALL
  SELECT i.conv_id, t.p, t.digest, t.n FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.p > i.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS d, n, string_agg(digest, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY p)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
  SELECT path, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS members, (count(*) - 1) * any_value(n) AS saved, CASE WHEN any_value(d) > 0 THEN left(path, (any_value(d) - 1) * 64) END AS parent FROM paths GROUP BY path
), kids AS (
  SELECT parent, count(*) AS kids FROM nodes GROUP BY parent
), ended AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, d) AS path FROM paths GROUP BY conv_id) GROUP BY path
), below AS (
  SELECT a.path, count(*) FILTER (k.kids IS NULL) AS leaves, sum(q.saved) AS saved FROM nodes q LEFT JOIN kids k ON k.parent = q.path JOIN paths a ON a.conv_id = q.conv_id AND a.d <= q.d GROUP BY a.path
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.members AS n_convs, coalesce(k.kids, 0) AS n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN nodes u ON u.path = n.parent LEFT JOIN kids k ON k.parent = n.path LEFT JOIN ended e ON e.path = n.path
"""


def op2() -> str:
    """Phrases by list positions, templates as regular expressions over the words joined by spaces. What a template begins with is looked for as a plain string first, as regular expressions are slow."""
    places = [
        (label, f"list_filter(range(1, len(ws) + 1), lambda i: {' AND '.join(f'ws[i + {k}] = {w!r}' if k else f'ws[i] = {w!r}' for k, w in enumerate(phrase.split()))})")
        for phrase, label in PHRASES.items()
    ]
    base = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN [{label!r}] ELSE [] END" for i, (label, _) in enumerate(places))
    found, shares = [], ["CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0 END"]
    for label, template in TEMPLATES.items():
        parts = parsed(template)
        words = [p for p in parts if isinstance(p, str)]
        so_far, seen, before, steps = " ", 0, "true", []
        for part in parts:
            so_far += _pattern(part)
            if isinstance(part, str):
                seen += 1
                steps.append(f"WHEN {before} AND regexp_matches(norm, '{so_far}') THEN {seen}::DOUBLE / {len(words)}::DOUBLE")
            before = " AND ".join(f"contains(norm, ' {w} ')" for w in words[: min(seen + 1, 4)])
        shares.append(f"CASE WHEN NOT contains(norm, ' {words[0]} ') THEN 0 {' '.join(reversed(steps))} ELSE 0 END")
        found.append(f"CASE WHEN {before} AND regexp_matches(norm, '{so_far}') THEN [{label!r}] ELSE [] END")
    every = " || ".join(f"p{i}" for i in range(len(places)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS low FROM documents)
), n AS (
  SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS norm, {", ".join(f"{sql} AS p{i}" for i, (_, sql) in enumerate(places))} FROM w
), b AS (
  SELECT *, len({every}) AS n_base, list_min({every}) AS lo, list_max({every}) AS hi, flatten([{base}]) AS bl, flatten([{", ".join(found)}]) AS tl FROM n
)
SELECT doc_id, len(ws) AS n_words, n_base, lo - 1 AS first_word, hi - 1 AS last_word, array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(bl || tl)), ',') AS labels, greatest({", ".join(shares)})::DOUBLE AS score
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op2_license_scan": op2(), "op4_min_max_hash": OP4, "op9_segment_search": OP9, "op10_url_filter": OP10, "op11_turn_trie": OP11}
