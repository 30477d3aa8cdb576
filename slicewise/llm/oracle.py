"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from slicewise.llm import mixing
from slicewise.llm.common import ORACLES
from slicewise.llm.license import COMMENT, END, KEYWORDS, RULES, families
from slicewise.llm.pii import ACCESS_KEY, CREDENTIAL, CREDENTIAL_NAME, IBAN, IBAN_CHARS

_COUNTRY = ", ".join(f"('{c}', {n})" for n, names in IBAN_CHARS.items() for c in names.split())
ORACLES["op10_pii"] = r"""
WITH country(code, chars) AS (VALUES %COUNTRY%),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
matched AS (
  SELECT rid, t, k.kind, k.pos,
         regexp_extract_all(t, '(?s)(.*?' || k.lead || ')(' || k.pattern || ')', 0) AS whole,
         regexp_extract_all(t, '(?s)(.*?' || k.lead || ')(' || k.pattern || ')', 2) AS hits
  FROM d CROSS JOIN (VALUES
    (1, 'email', '', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
    (2, 'ip', '', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
    (3, 'card', '', '[0-9](?:[ -]?[0-9])+'),
    (4, 'phone', '', '\+[0-9][ ().0-9-]+[0-9]'),
    (6, 'short_card', '', '[0-9](?:[ -]?[0-9])+'),
    (7, 'access_key', '', '%ACCESS_KEY%'),
    (8, 'credential', '%CREDENTIAL_NAME%', '%CREDENTIAL%')) k(pos, kind, lead, pattern)),
found AS (
  SELECT *, CAST(list_sum(list_transform(whole[1:i], lambda x: length(x))) AS BIGINT) AS stop,
         regexp_replace(hit, '[^0-9]', '', 'g') AS digits
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i, unnest(hits) AS hit FROM matched)),
checked AS (
  SELECT rid, t, kind, pos, stop - length(hit) AS start, stop,
         list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE
           WHEN j % 2 = 1 THEN CAST(reverse(digits)[j] AS INTEGER)
           WHEN reverse(digits)[j] > '4' THEN CAST(reverse(digits)[j] AS INTEGER) * 2 - 9
           ELSE CAST(reverse(digits)[j] AS INTEGER) * 2 END)) % 10 = 0 AS luhn,
         length(digits) AS n, hit
  FROM found),
near AS (
  SELECT *, lower(substr(t, greatest(start - 39, 1), start + 1 - greatest(start - 39, 1))
                  || ' ' || substr(t, stop + 1, 40)) AS around FROM checked),
kept AS (
  SELECT * FROM near WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: CAST(p AS DOUBLE) > 255)) = 0
    WHEN 'card' THEN n BETWEEN 16 AND 19 AND luhn
    WHEN 'phone' THEN n BETWEEN 8 AND 15
    WHEN 'access_key' THEN NOT regexp_matches(substr(t, start, least(start, 1)) || substr(t, stop + 1, 1), '[A-Za-z0-9]')
         AND (regexp_matches(around, 'secret|credential|login') OR NOT regexp_matches(around, 'example|dummy|placeholder'))
    WHEN 'credential' THEN regexp_matches(hit, '[A-Za-z]') AND n > 0
         AND (regexp_matches(around, 'login|server|account|private') OR NOT regexp_matches(around, 'example|dummy|placeholder'))
    ELSE n BETWEEN 13 AND 15 AND luhn
         AND regexp_matches(around, 'card|visa|amex|credit|karte|carte|tarjeta')
         AND NOT regexp_matches(around, 'serial|isbn|order') END),
begun AS (
  SELECT rid, i, regexp_extract(substr(t, i, 60), '^%IBAN%') AS whole
  FROM (SELECT rid, t, unnest(list_filter(range(1, length(t) - 2), lambda i:
               regexp_matches(substr(t, i, 4), '^[A-Z]{2}[0-9]{2}$'))) AS i
        FROM d WHERE regexp_matches(t, '[A-Z]{2}[0-9]{2}'))),
sized AS (
  SELECT rid, i - 1 AS start, CASE WHEN chars IS NULL THEN whole ELSE
         coalesce(whole[1:list_filter(range(1, length(whole) + 1), lambda j: whole[j] <> ' ')[chars]], '') END AS hit
  FROM begun LEFT JOIN country ON code = whole[1:2] WHERE whole <> ''),
valid AS (
  SELECT rid, start, start + length(hit) AS stop
  FROM (SELECT *, replace(hit, ' ', '')[5:] || replace(hit, ' ', '')[1:4] AS turned FROM sized)
  WHERE length(turned) BETWEEN 15 AND 34 AND list_reduce(
    list_prepend(0, list_transform(string_split(turned, ''), lambda c: CASE
        WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
    lambda a, v: CASE WHEN v > 9 THEN a * 100 + v ELSE a * 10 + v END % 97) = 1),
every AS (
  SELECT rid, kind, pos, start, stop FROM kept
  UNION ALL
  SELECT rid, 'iban', 5, start, stop FROM valid
  QUALIFY start >= coalesce(max(stop) OVER (PARTITION BY rid ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
per AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY pos, start)
           FILTER (pos <= 4) AS base, count(*) AS n_spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY pos, start) AS spans
  FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip,
       coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
""".replace("%COUNTRY%", _COUNTRY).replace("%IBAN%", IBAN).replace("%ACCESS_KEY%", ACCESS_KEY).replace(
    "%CREDENTIAL_NAME%", CREDENTIAL_NAME.replace("'", "''")).replace("%CREDENTIAL%", CREDENTIAL)

_WORDS = r"""list_filter(string_split(trim(regexp_replace(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' '), lambda x: x <> '')"""

ORACLES["op4_decontam"] = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (
         SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM (
           SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT rid, m, s, array_to_string(w[s:s + m - 1], ' ') AS win FROM (
         SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s
         FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT rid, item, dw.m, s FROM dw JOIN bw USING (m, win)),
p AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (
        SELECT rid, unnest(range(s, s + m)) AS x FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN i USING (rid)
"""


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = ", ".join("CASE " + " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN {quote(n)}" for n, p in rules) + " END"
                      for rules in families().values())
    steps, last = [], "r0"
    for k, (name, pattern) in enumerate(RULES, 1):
        hit = f"regexp_matches(seq, {quote(pattern)})"
        steps.append(f"""r{k} AS MATERIALIZED (SELECT rid,
  CASE WHEN {hit} THEN regexp_replace(seq, {quote(pattern)}, '|', 'g') ELSE seq END AS seq,
  CASE WHEN {hit} THEN list_append(names, {quote(name)}) ELSE names END AS names FROM {last})""")
        last = f"r{k}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT rid, i, trim(regexp_replace(p, '[^\x{{80}}-\x{{10FFFF}}0-9a-z]+', ' ', 'g'), ' ') AS s FROM (
    SELECT rid, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS p FROM (
      SELECT rid, string_split(regexp_replace(regexp_replace(chr(10) || t, {quote(COMMENT)}, chr(10), 'g'),
                               {quote(END)}, chr(1), 'g'), chr(1)) AS parts FROM d))),
m AS (SELECT rid, i, list_filter([{cases}], lambda x: x IS NOT NULL) AS found FROM s
      WHERE regexp_matches(s, {quote(KEYWORDS)})),
n AS (SELECT rid, i, unnest(CASE WHEN len(found) > 0 THEN found ELSE ['?'] END) AS id,
             unnest(range(greatest(len(found), 1))) AS k FROM m),
g AS (SELECT rid, list(id ORDER BY i, k) AS ids FROM n GROUP BY rid),
r0 AS (SELECT rid, '|' || array_to_string(ids, '|') || '|' AS seq, []::VARCHAR[] AS names FROM g),
{", ".join(steps)}
SELECT doc_id, coalesce(len(list_filter(ids, lambda x: x <> '?')), 0)::BIGINT AS n_known,
       coalesce(len(list_filter(ids, lambda x: x = '?')), 0)::BIGINT AS n_unknown,
       coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(names, ','), '') AS licenses
FROM d LEFT JOIN g USING (rid) LEFT JOIN {last} USING (rid)
"""


ORACLES["op5_license"] = _license_sql()

ORACLES["op3_topk"] = """
WITH e AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, x.vec_id,
        CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
      FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES["op2_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
  FROM range(2) t(x)),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(length(text)) FILTER (role = 'assistant') AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(text, '[\\#<]', '__', 'g')) + 8
      + CASE WHEN role IN ('user', 'system', 'assistant') THEN length(role) + 6
             ELSE length(regexp_replace(coalesce(role, ''), '[\\#<:]', '__', 'g')) + 7 END) AS formatted_chars,
  bool_and(coalesce(CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN last = 'user' THEN role = 'assistant'
                         WHEN last IN ('system', 'assistant') THEN role = 'user' ELSE false END, false)) AS valid
  FROM p GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, turns_sha256, coalesce(loss_chars, 0)::BIGINT AS loss_chars, loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, valid FROM g
"""


def mixing_sql(docs: str = "documents", columns: str | None = None) -> str:
    """Raking as a recursion over window sums. ``columns``: return those of the sampled rows."""
    marks = " ".join("WHEN " + " OR ".join(f"contains(t, '{m}')" for m in ms) + f" THEN '{n}'"
                     for n, ms in mixing.TOPIC_MARKS)
    dims = ", ".join(mixing.DIMS)
    goals, off, inner = [], [], "rake"
    for d in mixing.DIMS:
        goals.append(f"""s_{d} AS (SELECT {d}, CAST(sum(tokens) AS DOUBLE) AS s FROM c GROUP BY {d}),
n_{d} AS (SELECT {d}, pow(s, {mixing.TEMPER[d]}) / sum(pow(s, {mixing.TEMPER[d]})) OVER () AS t,
  s / (sum(s) OVER () * {mixing.SHARE}) AS most FROM s_{d}),
f_{d} AS (SELECT *, sum(most) OVER o AS cut, 1 - sum(t) OVER o AS rest FROM n_{d}
  WINDOW o AS (ORDER BY most / t, {d} ROWS UNBOUNDED PRECEDING)),
t_{d} AS (SELECT {d}, least(most, t * greatest(1.0, max((1 - cut) / rest) FILTER (rest > 1e-9) OVER ())) AS t_{d} FROM f_{d})""")
        where = f"WHERE n < {mixing.ROUNDS} AND NOT done" if inner == "rake" else ""
        inner = f"""(SELECT * EXCLUDE (cut, rest) REPLACE (CASE WHEN t_{d} > cut AND rest > 0 THEN u * (t_{d} - cut) / rest
    WHEN t_{d} >= cut THEN u ELSE least(u, cap) * t_{d} / (cut + rest) END AS u)
  FROM (SELECT *, sum(CASE WHEN u >= cap THEN cap ELSE 0 END) OVER (PARTITION BY {d}) AS cut,
    sum(CASE WHEN u >= cap THEN 0 ELSE u END) OVER (PARTITION BY {d}) AS rest FROM {inner} {where}))"""
        off.append(f"abs(sum(least(u, cap)) OVER (PARTITION BY {d}) - t_{d})")
    held = f"{dims}, tokens, cap, t_source, t_lang, t_topic, u"
    goals.append(f"""rake AS (
  SELECT 0 AS n, {dims}, tokens, tokens / (sum(tokens) OVER () * {mixing.SHARE}) AS cap, t_source, t_lang, t_topic,
    tokens / sum(tokens) OVER () AS u, false AS done
  FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
  UNION ALL
  SELECT n + 1 AS n, {held}, (n + 1) % {mixing.BLOCK} = 0 AND max(off) OVER () <= {mixing.TOLERANCE} AS done
  FROM (SELECT n, {held}, greatest({", ".join(off)}) AS off FROM {inner}))""")
    final = "doc_id, source, lang, topic, n_tokens, ratio, p, u < p AS sampled"
    return f"""
WITH RECURSIVE d AS (SELECT *, coalesce(text, '') AS t FROM {docs}),
p AS (SELECT d.* EXCLUDE (source, lang, t), d.source AS source0, d.lang AS lang0, coalesce(source, '{mixing.NONE}') AS source,
  coalesce(lang, '{mixing.NONE}') AS lang,
  CASE {marks} WHEN length(t) >= {mixing.LONG_CHARS} THEN 'long' ELSE 'short' END AS topic,
  CAST(len(regexp_extract_all(t, '[^\\x09-\\x0D\\x20]+')) AS BIGINT) AS n_tokens,
  CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '-')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM d),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens
  FROM p WHERE n_tokens > 0 GROUP BY ALL),
{", ".join(goals)},
r AS (SELECT source, lang, topic, least(u, cap) / (tokens / sum(tokens) OVER ()) AS x
  FROM (SELECT * FROM rake WHERE n = (SELECT max(n) FROM rake))),
o AS (SELECT p.*, CASE WHEN n_tokens > 0 THEN coalesce(round(x, 9), 0) ELSE 0.0::DOUBLE END AS ratio,
  CASE WHEN n_tokens > 0 THEN coalesce(round(least(1.0, x * {mixing.SHARE}), 9), 0) ELSE 0.0::DOUBLE END AS p
  FROM p LEFT JOIN r USING (source, lang, topic))
SELECT {columns or final} FROM o {"WHERE u < p" if columns else ""}
"""


ORACLES["op1_mixing"] = mixing_sql()

ORACLES["op11_filters"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
said AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
combos AS (
  SELECT part, mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n
  FROM failed LEFT JOIN said USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON b.bit <> a.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
  JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit = 31 - a.bit - b.bit - c.bit - d.bit),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (mask & (earlier | bit) = 0) AS kept,
         sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0) AS removed,
         sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails,
         sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0 AND good) AS good_lost,
         sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0 AND toxic) AS toxic_lost
  FROM combos, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM counted
"""
