"""DuckDB statements that give the same rows as the queries, written independently of them."""

from __future__ import annotations

from .pii import CONTEXT_WORDS
from .repetition import DUPLICATE_LIMITS, LINE_LIMIT, TOP_LIMITS

WORD = r"[^\x20\x09-\x0D]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REACH = """
reach(id, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT id, min(other) AS other FROM reach GROUP BY id)"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), {REACH}
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, least(m.vec_id, coalesce(l.other, m.vec_id)) AS component_id,
  m.vec_id = least(m.vec_id, coalesce(l.other, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = m.vec_id
LEFT JOIN least l ON l.id = m.vec_id
"""

OP3 = """
WITH steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) r(i))
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, coalesce(doc_id::VARCHAR, '') AS k,
    CASE WHEN coalesce(text, '') = '' THEN []::BIGINT[] ELSE list_transform(
      string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '), lambda h: ('0x' || h)::BIGINT) END AS bytes
  FROM documents
), s AS (
  SELECT doc_id, size, k,
    xor(4294967295, list_reduce(bytes, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) AS text_crc32,
    list_transform(range(41), lambda j: {'score': -ln((('0x' || substr(md5(k || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0), 'shard': j}) AS scores
  FROM d, steps
), w AS (
  SELECT doc_id, size, k, text_crc32, list_sort(scores[1:40])[1].shard::INT AS shard, list_sort(scores)[1].shard::INT AS grown_shard FROM s
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM w
"""

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b"


def _matches(name: str, pattern: str) -> str:
    """(doc_id, body, m, s, e) of each match: where pieces and matches before it end."""
    return f"""
{name} AS (
  SELECT doc_id, body, ms[i] AS m,
    (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT doc_id, body, regexp_extract_all(body, '{pattern}') AS ms, string_split_regex(body, '{pattern}') AS ps FROM docs), unnest(range(1, len(ms) + 1)) u(i)
)"""


LUHN = """list_sum(list_transform(range(length(d)), lambda i:
    CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i, 1)::INT
    ELSE 2 * substr(d, length(d) - i, 1)::INT - CASE WHEN substr(d, length(d) - i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
MOD97 = """list_reduce(list_transform(range(1, length(moved) + 1), lambda i: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(moved, i, 1)) - 1),
    lambda r, x: (CASE WHEN x > 9 THEN r * 100 ELSE r * 10 END + x) % 97, 0) = 1"""

OP4 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
{_matches("emails", EMAIL)}, {_matches("ips", IP)}, {_matches("cards", CARD)}, {_matches("phones", PHONE)}, {_matches("ibans", IBAN)},
digits AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM cards),
good AS (SELECT doc_id, body, m, s, d FROM digits WHERE length(d) BETWEEN 13 AND 19 AND {LUHN}),
base AS (
  SELECT doc_id, 1 AS k, 'email' AS kind, s, s + length(m) AS e FROM emails
  UNION ALL SELECT doc_id, 2, 'ip', s, s + length(m) FROM ips
    WHERE len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR ('0' || ltrim(p, '0'))[-3:]::INT > 255)) = 0
  UNION ALL SELECT doc_id, 3, 'card', s, s + length(m) FROM good WHERE length(d) >= 16
  UNION ALL SELECT doc_id, 4, 'phone', s, s + length(m) FROM phones WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15
), accounts AS (
  SELECT doc_id, 5 AS k, 'iban' AS kind, s, s + length(m) AS e FROM (
    SELECT *, replace(m, ' ', '') AS t, substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4) AS moved FROM ibans)
  WHERE length(t) BETWEEN 15 AND 34 AND {MOD97}
), firm AS (SELECT * FROM base UNION ALL SELECT a.* FROM accounts a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)),
allspans AS (
  SELECT * FROM firm
  UNION ALL SELECT doc_id, 6, 'card_short', s, s + length(m) FROM good g
  WHERE length(d) < 16
    AND regexp_matches(lower(substr(body, greatest(s - 40, 0) + 1, (s - greatest(s - 40, 0))::BIGINT) || ' ' || substr(body, s + length(m) + 1, 40)), '\\b(?:{"|".join(CONTEXT_WORDS["card_short"])})')
    AND NOT EXISTS (SELECT 1 FROM firm b WHERE b.doc_id = g.doc_id AND b.s < g.s + length(m) AND g.s < b.e)
), joined AS (
  SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k <= 4) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans, count(*) FILTER (k > 4) AS n_added
  FROM allspans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added
FROM documents LEFT JOIN joined USING (doc_id)
"""


def _gram(n: int) -> str:
    """The window of n words that begins at a word, as one text; null where fewer follow."""
    return " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, n))])


def _covered(n: int) -> str:
    """Words and characters of each text inside n-word windows found twice or more in it."""
    return f"""
w{n} AS (
  SELECT doc_id, i, chars, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1 AS inside
  FROM (SELECT doc_id, i, chars, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice
    FROM (SELECT doc_id, i, length(word) AS chars, {_gram(n)} AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)))
), c{n} AS (SELECT doc_id, count(*) FILTER (inside) AS n_in, coalesce(sum(chars) FILTER (inside), 0) AS chars_in FROM w{n} GROUP BY doc_id)"""


def _top(n: int) -> str:
    """Characters in the most frequent n-word window that occurs twice or more, the longest of equals."""
    return f"""
t{n} AS (
  SELECT doc_id, arg_max(times * size, (times, size)) AS chars_in FROM (
    SELECT doc_id, count(*) AS times, length(gram) - {n - 1} AS size
    FROM (SELECT doc_id, {_gram(n)} AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL GROUP BY doc_id, gram HAVING count(*) > 1)
  GROUP BY doc_id
)"""


_TOPS, _DUPLICATES = list(TOP_LIMITS), list(DUPLICATE_LIMITS)
_VERDICT = " AND ".join(
    [f"coalesce(l.chars, 0)::DOUBLE / d.word_chars / {LINE_LIMIT} <= 1.0"]
    + [f"coalesce(t{n}.chars_in, 0)::DOUBLE / d.word_chars / {TOP_LIMITS[n]} <= 1.0" for n in _TOPS]
    + [f"coalesce(c{n}.chars_in, 0)::DOUBLE / d.word_chars / {DUPLICATE_LIMITS[n]} <= 1.0" for n in _DUPLICATES]
)
_JOINS = " ".join(f"LEFT JOIN {x} ON {x}.doc_id = d.doc_id" for x in [*(f"t{n}" for n in _TOPS), *(f"c{n}" for n in _DUPLICATES)])

OP7 = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents
), d AS (
  SELECT *, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM split
), words AS (SELECT doc_id, i, ws[i] AS word FROM d, unnest(range(1, n_words + 1)) u(i)),
l AS (
  SELECT doc_id, sum((times - 1) * chars) AS chars FROM (
    SELECT doc_id, count(*) AS times, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM d, unnest(lines) u(x) GROUP BY doc_id, x)
  GROUP BY doc_id
), {", ".join([*map(_top, _TOPS), *map(_covered, _DUPLICATES)])},
f AS (SELECT doc_id, coalesce(n_in, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c5 USING (doc_id))
SELECT d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, f.n_repeat_words,
  d.n_words < 10 OR 100 * f.n_repeat_words > 20 * d.n_words AS base_failed,
  NOT (d.n_words < 10 OR 100 * f.n_repeat_words > 20 * d.n_words) AND {_VERDICT} AS kept
FROM d JOIN f ON f.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id {_JOINS}
"""

OP8 = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[][] WHEN len(ws) < 3 THEN [ws]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) END AS s FROM split
), grams AS (SELECT doc_id, len(s) AS n, x FROM sets, unnest(s) u(x)),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), {REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id FROM sets LEFT JOIN least ON id = doc_id
"""

OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), r AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), c AS (
  SELECT *, substr(t, 1, least(x, y)) AS p, substr(t, least(x, y) + 1, abs(x - y)) AS m, substr(t, greatest(x, y) + 1) AS s FROM r
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM c
), again AS (
  SELECT *, CASE form WHEN 'plain' THEN [output] WHEN 'psm' THEN string_split_regex(output[4:], '<S>|<M>') ELSE string_split_regex(output[4:], '<P>|<M>') END AS z FROM o
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN z[1] WHEN 'psm' THEN z[1] || z[3] || z[2] ELSE z[2] || z[3] || z[1] END) AS restored_sha256
FROM again
"""


def _assigned(name: str, books: str) -> str:
    """The nearest entry of each part, ties to the lower index."""
    return f"""
{name} AS MATERIALIZED (
  SELECT r, k, any_value(x) AS x, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT p.r, p.k, p.x, c.j, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM p JOIN {books} c ON c.k = p.k)
  GROUP BY r, k
)"""


def _renewed(name: str, books: str, assigned: str) -> str:
    """Componentwise floor of the mean; unused entries stay."""
    return f"""
{name} AS MATERIALIZED (
  SELECT o.k, o.j, coalesce(f.c, o.c) AS c FROM {books} o LEFT JOIN (
    SELECT k, j, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT k, j, i, sum(x[i]) AS s, count(*) AS n FROM {assigned}, unnest(range(1, len(x) + 1)) u(i) GROUP BY k, j, i)
    GROUP BY k, j) f ON f.k = o.k AND f.j = o.j
)"""


OP13 = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS r, vec_id, label, e FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
), p AS MATERIALIZED (
  SELECT r, k, e[len(e) // 16 * k + 1 : len(e) // 16 * (k + 1)] AS x FROM v, range(16) t(k)
), c0 AS MATERIALIZED (SELECT k, r - 1 AS j, x AS c FROM p WHERE r <= 64),
{_assigned("a0", "c0")}, {_renewed("c1", "c0", "a0")}, {_assigned("a1", "c1")}, {_renewed("c2", "c1", "a1")}, {_assigned("a2", "c2")},
codes AS (SELECT r, string_agg(printf('%02x', j), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT v.vec_id, code, error, (sum(error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(q::VARCHAR, ',' ORDER BY k, j, i)) FROM (SELECT k, j, i, c[i] AS q FROM c2, unnest(range(1, len(c) + 1)) u(i))) AS codebooks_sha256
FROM v JOIN codes ON codes.r = v.r
"""

ORACLES = {
    "op1_sorted_projection_dedup": OP1,
    "op3_rendezvous_shards": OP3,
    "op4_pii_spans": OP4,
    "op7_repetition_coverage": OP7,
    "op8_count_tree_jaccard": OP8,
    "op12_bit_parallel_middle": OP12,
    "op13_heap_lloyd_codes": OP13,
}
