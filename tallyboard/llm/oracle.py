"""DuckDB answers of the operators that SQL can express."""

from __future__ import annotations

from tallyboard.llm import lines

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

CHAT = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list(role || chr(1) || text ORDER BY pos) AS l FROM t GROUP BY conv_id),
kept AS (
  SELECT conv_id, n FROM c AS a
  WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.n > a.n AND b.l[1:a.n] = a.l)
    AND NOT EXISTS (SELECT 1 FROM c AS b WHERE b.l = a.l AND b.conv_id < a.conv_id))
SELECT conv_id, CAST((pos - 1) // 1024 AS BIGINT) AS part, n AS n_turns,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM kept JOIN t USING (conv_id) GROUP BY conv_id, part, n
"""


def line_cleaning() -> str:
    ends = "".join(lines.TERMINAL).replace("'", "''").replace("]", r"\]")
    furniture = "|".join(lines.BOILERPLATE)
    noise, separators = lines.NOISE, lines.SEPARATORS
    words = f"regexp_extract_all(text, {_SPACED})"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {words.replace("text", "coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_SPACED})) AS l
  FROM documents),
g AS (
  SELECT *, list_filter(l, lambda x:
      len(regexp_extract_all(x, '{noise}')) <= 0.06 * length(x)
      AND (length(x) <= 80 OR contains(x, '. ')
        OR regexp_matches(rtrim(replace(replace(x, chr(13), ' '), chr(9), ' '), ' '), '[{ends}]$'))
      AND NOT (len(regexp_extract_all(x, '{separators}')) >= 3
        AND len(regexp_extract_all(x, '{separators}')) >= 0.04 * length(x))
      AND NOT regexp_matches(lower(x), '{furniture}')) AS good
  FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
many AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN many USING (doc_id, s)) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(good) AS BIGINT) AS n_removed_lines,
    CAST(length(regexp_replace(array_to_string(good, ' '), '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS cleaned_chars
  FROM g LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND cleaned_chars >= 0.5 * word_chars AS kept
FROM m
"""


DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (s, n)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS c, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h, 0) AS n_hit, coalesce(c, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_SPACED}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM common JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b FROM both_ways UNION SELECT r.doc_id, e.b FROM reach AS r JOIN both_ways AS e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""


#: crc32 byte by byte, from its table; the words' code points are below 256, so one has two bytes at most.
SPELLING = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
distinct_runs AS (
  SELECT doc_id, w, count(*) AS n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) & 63 | 128)::BIGINT] END)) AS b
  FROM runs WHERE length(w) >= 5 GROUP BY doc_id, w),
hashed AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295::BIGINT], b),
      lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8)), 4294967295) AS h
  FROM distinct_runs, crc),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (
  SELECT word, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS l
  FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
  SELECT a.word, b.word AS other FROM less AS a JOIN less AS b USING (i, l) WHERE a.word <> b.word
  UNION SELECT a.word, b.word FROM less AS a JOIN words AS b ON a.l = b.word
  UNION SELECT b.word, a.word FROM less AS a JOIN words AS b ON a.l = b.word),
best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS other, max(w.n) AS other_n
  FROM near JOIN words AS w ON w.word = other GROUP BY near.word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
    CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms AS f ON f.word = walk.next)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM forms AS f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""

_TERMS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    {_TERMS} AS w
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS t
  FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (
  SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
g AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM f, s),
m AS (SELECT r, doc_id, CAST(10 + (90 * len(w)::BIGINT * nn) // l AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
c AS (
  SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN g USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(k AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k FROM c WHERE score > 0)
WHERE k <= 10
"""


def build() -> dict[str, str]:
    return {
        "op2_chat_format": CHAT,
        "op3_line_cleaning": line_cleaning(),
        "op5_decontamination": DECONTAMINATION,
        "op12_spelling_variants": SPELLING,
        "op13_ranked_search": SEARCH,
        "op7_jaccard_join": JACCARD,
    }
