"""DuckDB SQL for the rows of the operators' queries, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, coalesce('=' || lang, 'null') AS l, coalesce('=' || source, 'null') AS s, coalesce(text, '') AS text,
         {_SPACE_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 5) AS r(j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, l, s, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(text) AS n_code_points
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN n_code_points > 0 THEN 10000 * n_symbols // n_code_points ELSE 0 END AS symbol,
         CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS dup_line,
         CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END AS repeat,
         CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length
  FROM m),
v AS (UNPIVOT (SELECT l, s, symbol, dup_line, repeat, word_length FROM f WHERE NOT base_failed)
      ON symbol, dup_line, repeat, word_length INTO NAME feature VALUE x),
b AS (
  SELECT l, s, feature, (x >> e) << e AS bucket, count(*) AS n
  FROM (SELECT *, greatest(0, length(bin(x)) - 8) AS e FROM v) GROUP BY ALL),
q AS (
  SELECT l, s, feature, bucket, level, sum(n) OVER up AS cum, sum(n) OVER whole AS total
  FROM (SELECT 0 AS level, l, s, feature, bucket, n FROM b
        UNION ALL SELECT 1, l, '', feature, bucket, sum(n) FROM b GROUP BY ALL
        UNION ALL SELECT 2, '', '', feature, bucket, sum(n) FROM b GROUP BY ALL)
  WINDOW whole AS (PARTITION BY level, l, s, feature), up AS (PARTITION BY level, l, s, feature ORDER BY bucket)),
k AS (
  SELECT level, l, s, feature, max(total) AS n, min(bucket) FILTER (4 * cum >= total) AS q1,
         min(bucket) FILTER (4 * cum >= 3 * total) AS q3
  FROM q GROUP BY ALL),
p AS (
  SELECT a.l, a.s, a.feature, CASE WHEN a.n >= 200 THEN a.q1 WHEN b.n >= 200 THEN b.q1 ELSE c.q1 END AS q1,
         CASE WHEN a.n >= 200 THEN a.q3 WHEN b.n >= 200 THEN b.q3 ELSE c.q3 END AS q3
  FROM k a JOIN k b ON b.level = 1 AND a.l = b.l AND a.feature = b.feature JOIN k c ON c.level = 2 AND a.feature = c.feature
  WHERE a.level = 0),
t AS (
  SELECT l, s, max(q3 + 3 * greatest(q3 - q1, 100)) FILTER (feature = 'symbol') AS symbol_hi,
         max(q3 + 3 * greatest(q3 - q1, 1200)) FILTER (feature = 'dup_line') AS dup_hi,
         max(q3 + 3 * greatest(q3 - q1, 667)) FILTER (feature = 'repeat') AS repeat_hi,
         max(q3 + 6 * greatest(q3 - q1, 30)) FILTER (feature = 'word_length') AS length_hi,
         max(q1 - 6 * greatest(q3 - q1, 30)) FILTER (feature = 'word_length') AS length_lo
  FROM p GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND symbol <= symbol_hi AND dup_line <= dup_hi AND repeat <= repeat_hi
                AND (n_words < 50 OR word_length BETWEEN length_lo AND length_hi), false) AS kept
FROM f LEFT JOIN t USING (l, s)
"""

DECONTAMINATE = rf"""
WITH iw AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
  FROM iw, unnest(range(1, greatest(len(w) - 8, 2))) AS r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
dg AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM dw, (SELECT DISTINCT k FROM win), unnest(range(1, len(w) - k + 2)) AS r(i)),
hits AS (SELECT doc_id, item_id, i, win.k FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
words AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT doc_id, i, k FROM hits), unnest(range(0, k)) AS r(j)
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS x
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length('<turn role="') + length('">') + length('</turn>') + 1
         + length(replace(replace(role, '&', '&amp;'), '<', '&lt;'))
         + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS n FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars,
       regexp_matches(string_agg(role || ',', '' ORDER BY turn, role, text), '^(system,)?(user,assistant,)+$') AS valid
FROM e GROUP BY conv_id
"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 2, 2))) AS r(i)
  WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a),
links AS (SELECT a AS doc_id, count(*) AS k FROM link GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c::BIGINT AS component_id, coalesce(k, 0)::BIGINT AS n_links
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id) LEFT JOIN links USING (doc_id)
"""

LM = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, i, w[i] AS x, w[i - 1] AS h, w[i - 2] AS g FROM w, unnest(range(1, len(w) + 1)) AS r(i)),
total AS (SELECT count(*) AS n FROM u),
c1 AS (SELECT doc_id, x, count(*) AS own FROM u GROUP BY ALL),
t1 AS (SELECT x, sum(own) AS c FROM c1 GROUP BY x),
c2 AS (SELECT doc_id, h, x, count(*) AS own FROM u WHERE i > 1 GROUP BY ALL),
t2 AS (SELECT h, x, sum(own) AS c FROM c2 GROUP BY ALL),
c3 AS (SELECT doc_id, g, h, x, count(*) AS own FROM u WHERE i > 2 GROUP BY ALL),
t3 AS (SELECT g, h, x, sum(own) AS c FROM c3 GROUP BY ALL),
one AS (SELECT doc_id, c1.x, t1.c - own AS c FROM c1 JOIN t1 USING (x)),
two AS (SELECT doc_id, c2.h, c2.x, t2.c - own AS c FROM c2 JOIN t2 ON c2.h = t2.h AND c2.x = t2.x),
three AS (SELECT doc_id, c3.g, c3.h, c3.x, t3.c - own AS c FROM c3 JOIN t3 ON c3.g = t3.g AND c3.h = t3.h AND c3.x = t3.x),
s AS (
  SELECT u.doc_id, ln(greatest(a.c, 1)) - ln(greatest(total.n - len(w.w), 1)) AS single, two.c AS both_c, b.c AS context,
         three.c AS three_c, before.c AS context2, u.i
  FROM u JOIN w USING (doc_id) CROSS JOIN total JOIN one a ON a.doc_id = u.doc_id AND a.x = u.x
  LEFT JOIN two ON two.doc_id = u.doc_id AND two.h = u.h AND two.x = u.x
  LEFT JOIN one b ON b.doc_id = u.doc_id AND b.x = u.h
  LEFT JOIN three ON three.doc_id = u.doc_id AND three.g = u.g AND three.h = u.h AND three.x = u.x
  LEFT JOIN two before ON before.doc_id = u.doc_id AND before.h = u.g AND before.x = u.h),
p AS (SELECT *, CASE WHEN i = 1 THEN single WHEN both_c > 0 THEN ln(both_c) - ln(greatest(context, 1)) ELSE ln(0.4) + single END AS pair FROM s),
d AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN i <= 2 THEN pair WHEN three_c > 0 THEN ln(three_c) - ln(greatest(context2, 1)) ELSE ln(0.4) + pair END) AS v
  FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(v / n, 6) AS lm_score FROM documents LEFT JOIN d USING (doc_id)
"""


def _fill(rows: str, parent: str, budget: str, capacity: str, order: str, keep: str, out: str) -> str:
    """Weighted shares of a parent's budget, as in ``mixing.fill``."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
  SELECT {keep}, CASE WHEN every <= {budget} THEN {capacity} ELSE least({capacity}, floor(top * w)::BIGINT) END::BIGINT AS {out}
  FROM (SELECT *, max(level) OVER ({part}) AS top, sum({capacity}) OVER ({part}) AS every
        FROM (SELECT *, ({budget} - coalesce(sum({capacity}) OVER ({part} ORDER BY {capacity}::DOUBLE / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                        / sum(w) OVER ({part} ORDER BY {capacity}::DOUBLE / w, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM ({rows})))"""


MIXING = rf"""
WITH r AS (
  SELECT doc_id, coalesce(CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web'
              WHEN right(source, 1) IN ('5', '6', '7') THEN 'books' ELSE 'forum' END, '<null>') AS d,
         coalesce(lang, '<null>') AS l, coalesce(source, '<null>') AS s, len({_SPACE_WORDS})::BIGINT AS t,
         coalesce(doc_id::VARCHAR, 'null') AS id, md5(coalesce(text, '')) AS x FROM documents),
leaf AS (SELECT d, l, s, sum(t)::BIGINT AS tokens, (2 * sum(t))::BIGINT AS c FROM r GROUP BY ALL HAVING sum(t) > 0),
bd AS ({_fill("SELECT d, sum(c)::BIGINT AS c, CASE d WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END AS w, (80 * (SELECT sum(tokens) FROM leaf)::BIGINT) // 100 AS b FROM leaf GROUP BY d", "", "b", "c", "d", "d", "bd")}),
bl AS ({_fill("SELECT d, l, sum(c)::BIGINT AS c, any_value(bd) AS bd, CASE l WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 1 END AS w FROM leaf JOIN bd USING (d) GROUP BY d, l", "d", "bd", "c", "l", "d, l", "bl")}),
bs AS ({_fill("SELECT d, l, s, tokens, c, bl, 1 AS w FROM leaf JOIN bl USING (d, l)", "d, l", "bl", "c", "s", "d, l, s, tokens", "b")}),
k AS (
  SELECT r.*, b // tokens AS whole, b % tokens AS rest, md5('17|' || (b // tokens)::VARCHAR || '|' || id || '|' || x) AS k
  FROM r JOIN bs USING (d, l, s)),
o AS (SELECT *, sum(t) OVER (PARTITION BY d, l, s ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM k)
SELECT doc_id, d AS domain, l AS lang, s AS source, t AS n_tokens, (whole + (rest > 0 AND cum <= rest)::INT)::BIGINT AS copies
FROM o WHERE whole + (rest > 0 AND cum <= rest)::INT > 0
"""

PHRASES = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM w, unnest(range(1, 6)) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS x FROM g WHERE k > 1),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN unnest(range(1, 5)) AS s(j) ON j < k JOIN n ON n.lang = c.lang
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(x[1:j], ' ')
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(x[j + 1:], ' ')),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (
  SELECT DISTINCT worst.lang, worst.phrase FROM worst JOIN worst o ON o.lang = worst.lang AND o.k > worst.k AND 100 * o.a >= 100 * worst.a
       AND contains(' ' || o.phrase || ' ', ' ' || worst.phrase || ' ')),
kept AS (SELECT worst.* FROM worst ANTI JOIN held USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a,
       l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {
    "op2_lm_score": LM,
    "op3_mixing": MIXING,
    "op4_quality_rules": QUALITY,
    "op6_chat": CHAT,
    "op7_jaccard_join": JACCARD,
    "op8_decontaminate": DECONTAMINATE,
    "op12_collocations": PHRASES,
}
