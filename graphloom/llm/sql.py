"""DuckDB SQL for the queries that SQL can express."""

OP5 = r"""
WITH rest AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
raw AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
u AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path
  FROM raw),
rules(verdict, rh, rp) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hits AS (
  SELECT DISTINCT u.host, u.path, rh || rp AS rule, verdict
  FROM u JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)),
best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM hits GROUP BY host, path)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM u LEFT JOIN best b ON u.host = b.host AND u.path = b.path
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS seq
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
j AS (
  SELECT t.conv_id, p.perspective, (t.seq - 1) // 4096 AS part, t.seq, CAST(t.speaker = p.perspective AS INT) AS own,
    '<|im_start|>' || CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system'
      ELSE 'user name=' || t.speaker END || chr(10) AS lead,
    t.said || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (
  SELECT *, sum(length(lead) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY seq) AS e FROM j)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, min(seq) AS first_turn, CAST(min(e - length(lead) - length(body)) AS BIGINT) AS "offset", count(*) AS n_turns,
  string_agg(lead || body, '' ORDER BY seq) AS rendered,
  string_agg(CAST(own AS VARCHAR), '' ORDER BY seq) AS mask,
  coalesce(string_agg(CAST(e - length(body) AS VARCHAR) || '-' || CAST(e AS VARCHAR), ',' ORDER BY seq) FILTER (WHERE own = 1), '') AS spans,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own = 1), 0) AS BIGINT) AS loss_chars
FROM s GROUP BY conv_id, perspective, part
"""

OP12 = r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS pid, piece
  FROM (SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
s AS (SELECT lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT lang, pid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
g AS (
  SELECT lang, w AS w1, w || ' ' || lead(w, 1) OVER d AS w2, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d AS w3,
    w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d AS w4,
    w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d || ' ' || lead(w, 4) OVER d AS w5
  FROM w WINDOW d AS (PARTITION BY pid ORDER BY i)),
u AS (
  SELECT lang, w1 AS phrase, 1 AS k FROM g UNION ALL SELECT lang, w2, 2 FROM g WHERE w2 IS NOT NULL UNION ALL SELECT lang, w3, 3 FROM g WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, w4, 4 FROM g WHERE w4 IS NOT NULL UNION ALL SELECT lang, w5, 5 FROM g WHERE w5 IS NOT NULL),
f AS (SELECT lang, phrase, k, count(*) AS a, string_split(phrase, ' ') AS ws FROM u GROUP BY lang, phrase, k HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
j AS (
  SELECT c.lang, c.phrase, c.cut, c.a, l.a AS l, r.a AS r, n.n,
    (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM c JOIN n ON n.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
m AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT DISTINCT lang, a, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, a, k, ws, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT lang, a, k, ws, unnest(range(2, k)) AS size FROM f WHERE k > 2)))
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM m WHERE NOT EXISTS (SELECT 1 FROM inner_phrases x WHERE x.lang = m.lang AND x.phrase = m.phrase AND x.a >= m.a)
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY rank <= 2000
"""


def op2() -> str:
    """Quality rules: each n-gram length has its own window pass."""
    from .quality import MAX_DUP_LINE_PERCENT, MAX_GRAM_PERCENT, MAX_REPEAT_PERCENT, MIN_WORDS

    parts, columns, tests = [], [], [f"100 * coalesce(l.dup_line_chars, 0) <= {MAX_DUP_LINE_PERCENT} * coalesce(b.word_chars, 0)"]
    for n in (3, *MAX_GRAM_PERCENT):
        gram = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER d" for k in range(1, n))])
        value = "count(*)" if n == 3 else "sum(length(w))"
        parts.append(f"""
g{n} AS (SELECT rid, i, w, {gram} AS g FROM words WINDOW d AS (PARTITION BY rid ORDER BY i)),
h{n} AS (SELECT rid, i, w, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS dup FROM g{n}),
c{n} AS (SELECT rid, w, max(dup) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM h{n}),
s{n} AS (SELECT rid, {value} AS v FROM c{n} WHERE hit = 1 GROUP BY rid)""")
        if n > 3:
            columns.append(f"CAST(coalesce(s{n}.v, 0) AS BIGINT) AS dup_chars_{n}")
            tests.append(f"100 * coalesce(s{n}.v, 0) <= {MAX_GRAM_PERCENT[n]} * coalesce(b.word_chars, 0)")
    failed = f"(coalesce(b.n_words, 0) < {MIN_WORDS} OR 100 * coalesce(s3.v, 0) > {MAX_REPEAT_PERCENT} * b.n_words)"
    joins = " ".join(f"LEFT JOIN s{n} ON s{n}.rid = d.rid" for n in (3, *MAX_GRAM_PERCENT))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
b AS (SELECT rid, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM words GROUP BY rid),
ls AS (SELECT rid, string_split(text, chr(10)) AS xs FROM d),
li AS (SELECT rid, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM ls),
ln AS (SELECT rid, x, row_number() OVER (PARTITION BY rid, x ORDER BY i) AS k FROM li WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
l AS (SELECT rid, count(*) AS n, CAST(sum(length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g'))) AS BIGINT) AS dup_line_chars FROM ln WHERE k > 1 GROUP BY rid),
{",".join(parts)}
SELECT d.doc_id, coalesce(b.n_words, 0) AS n_words, coalesce(b.word_chars, 0) AS word_chars,
  CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, CAST(coalesce(s3.v, 0) AS BIGINT) AS n_repeat_words,
  coalesce(l.dup_line_chars, 0) AS dup_line_chars, {", ".join(columns)},
  {failed} AS base_failed, (NOT {failed} AND {" AND ".join(tests)}) AS kept
FROM d LEFT JOIN b ON b.rid = d.rid LEFT JOIN l ON l.rid = d.rid {joins}
"""
