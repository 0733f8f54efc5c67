"""DuckDB SQL for the corpus queries that SQL can express."""

from worklore.llm import quality_rules as q
from worklore.llm import url_filter as u

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
WORD = r"'[^\x20\x09-\x0D]+'"


def _strength(groups: str) -> str:
    return f"""(SELECT CASE WHEN n IS NULL OR g < 2 OR n <= g OR b = 0 OR b = n THEN {u.MOST} WHEN rho > 0 THEN least({u.MOST}, greatest({u.LEAST}, 1 / rho - 1)) ELSE {u.MOST} END
 FROM (SELECT *, ((ss - n * m * m) / n / (m * (1 - m)) - (g - 1) / n) / (1 - (g - 1) / n) AS rho FROM (SELECT n, b, g, ss, b / nullif(n, 0) AS m FROM
 (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS b, count(*)::DOUBLE AS g, sum(bad * bad / n::DOUBLE) AS ss FROM {groups} WHERE n > 0))))"""


def _rule(host: str, path: str, what: int) -> str:
    cases = []
    for action, rule in sorted(u.RULES, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        cases.append(f"WHEN ({host} = '{at}' OR suffix({host}, '.{at}')) AND prefix({path}, '{slash}{rest}') THEN '{(action, rule)[what]}'")
    return f"CASE {' '.join(cases)} END"


URLS = rf"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {UPPER}, {LOWER}) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
h0 AS (SELECT host, 0 AS n, 0 AS bad FROM p UNION ALL SELECT host, 1, CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END FROM p JOIN labels ON page_id = doc_id),
h1 AS (SELECT *, regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', '') AS bare FROM h0), h2 AS (SELECT *, array_to_string(string_split(bare, '.')[-2:], '.') AS two, regexp_matches(bare, '{u.ADDRESS}') AS address FROM h1),
h AS (SELECT host, CASE WHEN address THEN bare WHEN two IN {u.SUFFIXES} THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE two END AS domain,
 CASE WHEN address THEN '[address]' WHEN two IN {u.SUFFIXES} THEN two ELSE string_split(bare, '.')[-1] END AS suffix, sum(n) AS n, sum(bad) AS bad FROM h2 GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
k AS (SELECT {_strength('s')} AS ks, {_strength('d')} AS kd, {_strength('h')} AS kh, (SELECT (sum(bad) + 1) / (sum(n) + 2)::DOUBLE FROM h) AS m0),
sm AS (SELECT suffix, (m0 * ks + bad) / (ks + n) AS m FROM s, k), dm AS (SELECT d.domain, (m * kd + bad) / (kd + n) AS m FROM d JOIN sm USING (suffix), k),
hm AS (SELECT host, m * kh + bad AS a, (1 - m) * kh + n - bad AS b FROM h JOIN dm USING (domain), k),
j AS (SELECT p.*, {_rule('host', 'path', 1)} AS rule, {_rule('host', 'path', 0)} AS said FROM p)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN a / (a + b) - {u.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {u.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN hm USING (host)"""

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i, w FROM d WHERE len(w) > {q.WINDOW}),
named AS (SELECT doc_id, i, w[i:i+{q.WINDOW - 1}] AS win FROM wins),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM named) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range({q.WINDOW}) t(k) GROUP BY 1),
ln AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, len(regexp_extract_all(line, {WORD})) AS n, trim(regexp_replace(translate(line, {UPPER}, {LOWER}), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM ln),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw WHERE n > 0 GROUP BY 1),
freq AS (SELECT host, norm FROM lw WHERE n > 0 GROUP BY 1, 2 HAVING count(DISTINCT text) >= {q.MIN_DOCS}),
gone AS (SELECT doc_id, sum(n) AS removed_words FROM lw SEMI JOIN freq USING (host, norm) WHERE n > 0 GROUP BY 1),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS wc, (length(text) - length(translate(text, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols FROM d),
r AS (SELECT b.doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
 FROM b LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND n_words - removed_words < greatest({q.MIN_WORDS}, n_words * {q.MIN_KEPT})) AS kept FROM f"""

MARKS_RE = r"[<\[]/?(?:s>|INST|OUT|SYS|ROLE)"
SAID = "</s>[INST] ok [/INST]"

#: An escaped text is longer by one for each backslash and each mark; a rendered one has 14 characters and its name twice besides.
CHAT_FORMAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'),
m AS (
  SELECT *, 2 * length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '{MARKS_RE}')) AS body,
    CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 3 WHEN 'system' THEN 3
      ELSE 5 + 2 * length(role) - length(replace(role, chr(92), '')) + len(regexp_extract_all(role, '{MARKS_RE}')) + len(regexp_extract_all(role, '[\[\]]')) END AS name
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + 2 * name + body)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

ORACLE_SQL = {"op5_url_filter": URLS, "op9_quality_rules": QUALITY, "op10_chat_format": CHAT_FORMAT}
