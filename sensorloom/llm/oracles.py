"""SQL counterparts of the corpus queries, for DuckDB."""

from __future__ import annotations

from sensorloom.llm import quality, secrets

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(expression: str) -> str:
    return expression.replace("'", "''")


QUALITY = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
worded AS (
  SELECT *, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS lines FROM texts),
places AS (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3),
windows AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM places),
repeated AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows),
covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM repeated WHERE n > 1)
  GROUP BY r),
judged AS (
  SELECT *, list_filter(lines, lambda x: regexp_matches(x, '{WORD}')) AS own,
         list_filter(lines, lambda x: NOT (regexp_matches(x, '{WORD}') AND (
             (NOT regexp_matches(x, '{_quoted(quality.SENTENCE_END)}')
              AND len(regexp_extract_all(x, '{WORD}')) <= {quality.UNENDED_WORDS})
             OR (len(regexp_extract_all(x, '{quality.SEPARATOR}')) >= 2
                 AND len(regexp_extract_all(x, '{quality.SEPARATOR}')) * {quality.LINK_WORDS}
                     >= len(regexp_extract_all(x, '{WORD}')))
             OR (len(regexp_extract_all(x, '{quality.SHOUT}')) >= 2
                 AND len(regexp_extract_all(x, '{quality.SHOUT}')) * {quality.SHOUT_WORDS}
                     >= len(regexp_extract_all(x, '{WORD}')))
             OR regexp_matches(x, '{_quoted(quality.NAVIGATION)}')
             OR len(regexp_extract_all(x, '{quality.SYMBOLS}')) > {quality.SYMBOL_SHARE} * length(x)
             OR regexp_matches(x, '{_quoted(quality.BOILERPLATE)}')))) AS passing
  FROM worded),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(own) - len(list_distinct(own)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) - len(passing) AS BIGINT) AS n_bad_lines,
         length(regexp_replace(array_to_string(passing, chr(10)), '{SPACE}', '', 'g')) AS left_chars
  FROM judged LEFT JOIN covered USING (r)),
failed AS (
  SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 - CAST(left_chars AS DOUBLE) / greatest(word_chars, 1) <= {quality.MOST_LOST} AS kept,
       n_bad_lines
FROM failed"""


CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS t,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS r
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || r || chr(10) || t || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'user' AND length(text) >= 300) AS n_attachments,
       CAST(coalesce(sum(400 * ceil(length(text) / 100)) FILTER (role = 'user' AND length(text) >= 300), 0) AS BIGINT) AS expanded_tokens
FROM escaped GROUP BY conv_id"""


def _secrets() -> str:
    def found(kind: str, order: int) -> str:
        expression, group, least = secrets.SHAPES[kind]
        shape = _quoted(expression)
        return f"""
  SELECT doc_id, r, source, '{kind}' AS kind, {order} AS o, unnest(range(1, len(m) + 1)) AS i, m, v, p, {least} AS least
  FROM (SELECT doc_id, r, source, regexp_extract_all(t, '{shape}') AS m, regexp_extract_all(t, '{shape}', {group}) AS v,
               regexp_split_to_array(t, '{shape}') AS p FROM texts)"""

    every = " UNION ALL ".join(found(kind, order) for order, kind in enumerate(secrets.SHAPES, 1))
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
matches AS ({every}),
placed AS (
  SELECT doc_id, r, source, kind, o, v[i] AS value, least, length(m[i]) AS width,
         sum(length(p[i]) + length(m[i])) OVER (PARTITION BY r, kind ORDER BY i) AS stop
  FROM matches),
long AS (SELECT *, stop - width AS start FROM placed WHERE length(value) >= least),
inside AS (
  SELECT *, max(CASE WHEN kind <> '{secrets.OWNED}' THEN stop END) OVER (
              PARTITION BY r ORDER BY start, stop DESC, kind ROWS UNBOUNDED PRECEDING) >= stop AS hidden
  FROM long),
kept AS (
  SELECT * FROM inside
  WHERE kind <> '{secrets.OWNED}' OR (NOT coalesce(hidden, false)
    AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND len(list_distinct(string_split(value, ''))) >= {secrets.TOKEN_CHARACTERS})),
counts AS (
  SELECT value, count(DISTINCT source) AS owners, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS repositories
  FROM kept GROUP BY value),
named AS (
  SELECT *, owners < {secrets.EXAMPLE_OWNERS} AND repositories < {secrets.EXAMPLE_REPOSITORIES} AS live,
         kind || ':' || start || ':' || stop AS shown
  FROM kept JOIN counts USING (value)),
judged AS (SELECT * FROM named WHERE kind <> '{secrets.OWNED}' OR live),
grouped AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
         string_agg(shown, ',' ORDER BY start, o) AS spans,
         string_agg(shown, ',' ORDER BY start, o) FILTER (kind <> '{secrets.OWNED}') AS base
  FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM texts LEFT JOIN grouped USING (r)"""


SECRETS = _secrets()


MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS place
  FROM documents),
sources AS (SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY no_source, encode(source)) - 1 AS nth FROM sources),
weighed AS (SELECT *, CAST(nth % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS most FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS filling
  FROM weighed WINDOW o AS (ORDER BY most / weight, nth)),
settled AS (SELECT arg_min(level, filling) AS level FROM levels WHERE level * weight <= most),
targets AS (
  SELECT l.* EXCLUDE (level), least(CAST(most AS DOUBLE), coalesce(s.level * weight, 0)) AS target
  FROM levels l LEFT JOIN settled s ON true),
placed AS (
  SELECT *, CAST(round(target) AS BIGINT) AS wanted,
         sum(size) OVER (PARTITION BY no_source, source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized JOIN targets USING (no_source, source)),
copied AS (
  SELECT *, greatest(least(wanted - before, size), 0) AS once,
         greatest(least(wanted - before - source_size, size), 0) AS twice,
         greatest(least(wanted - before - 2 * source_size, size), 0) AS thrice
  FROM placed),
shared AS (
  SELECT *, least((before + once / 2) / wanted, 1.0) AS share,
         CASE nth % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END AS rate,
         CASE nth % 3 WHEN 0 THEN -1.0 WHEN 1 THEN 0.0 ELSE 1.0 END AS slope
  FROM copied)
SELECT doc_id, size, source_size, target, CAST(once + twice + thrice AS BIGINT) AS taken,
       CASE WHEN once > 0
            THEN round(2 * share / (rate + sqrt(greatest(rate * rate + 2 * slope * share, 0.0))), 6) END AS first_position
FROM shared"""


CONTAMINATION = rf"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{PLAIN_WORD}') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{PLAIN_WORD}') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS run
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(run) AS n FROM windows),
runs AS (
  SELECT r, i, n, list_slice(w, i, i + n - 1) AS run
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts JOIN lengths ON len(w) >= n)),
hits AS (SELECT r, i, n, item FROM runs JOIN windows USING (run)),
covered AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""


def _checksum_table() -> str:
    """What four bits do to a CRC-32, by its rule."""
    values = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        values.append(str(value))
    return f"[{', '.join(values)}]"


SHARDING = rf"""
WITH keyed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS bytes,
         substr(md5(coalesce(text, '')), 1, 10) AS text_key,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS id_key
  FROM documents),
sums AS (
  SELECT *, sum(size) OVER () AS total, count(*) OVER () AS n,
         coalesce(sum(size) OVER (ORDER BY text_key, id_key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0)
           AS before
  FROM keyed),
sharded AS (
  SELECT *, CAST(least(39, floor(before * 40 / total)) AS INTEGER) AS shard,
         (CAST(('0x' || text_key) AS BIGINT) + CAST(('0x' || id_key) AS BIGINT))
           % greatest(1, CAST(ceil(ceil(sqrt(n)) / 40) AS BIGINT)) AS cell
  FROM sums),
numbered AS (
  SELECT *, list_transform(regexp_extract_all(bytes, '..'), lambda p: CAST('0x' || p AS BIGINT)) AS octets FROM sharded)
SELECT doc_id, size,
       CAST(xor(list_reduce(octets, lambda c, o: xor(xor(xor(c, o) >> 4, table_of[(xor(c, o) & 15) + 1]) >> 4,
                                                     table_of[(xor(xor(c, o) >> 4, table_of[(xor(c, o) & 15) + 1]) & 15) + 1]),
                            4294967295), 4294967295) AS BIGINT) AS text_crc32,
       'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY cell, text_key, id_key, doc_id) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM numbered, (SELECT CAST({_checksum_table()} AS BIGINT[]) AS table_of)"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and means, each as a step; distances come from dot products, exact as doubles."""
    apart = "list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c)"

    def assigned(n: int) -> str:
        return f"""
near{n} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min({{'d': {apart}, 'e': e}}) AS best FROM points JOIN book{n} USING (p) GROUP BY r, p)"""

    def refined(n: int) -> str:
        return f"""
sums{n} AS (
  SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT p, best.e AS e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM near{n}) GROUP BY p, e, i),
means{n} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM sums{n} GROUP BY p, e),
book{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN means{n} m USING (p, e))"""

    steps = ",".join(step for n in range(rounds) for step in (assigned(n), refined(n)))
    return f"""
WITH whole AS (
  SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
         list_transform(v, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM whole),
points AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x
  FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS (SELECT p, r - 1 AS e, x AS c FROM points WHERE r <= {entries}),{steps},{assigned(rounds)},
coded AS (
  SELECT r, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY r),
digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS h
  FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


VECTOR_CODES = _vector_codes()


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}')"


SEARCH = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, {_terms('text')} AS w FROM documents),
items AS (
  SELECT item_id, row_number() OVER () AS q, list_distinct({_terms('text')}) AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
totals AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM texts WHERE len(w) > 0),
wanted AS (SELECT q, item_id, unnest(w) AS term FROM items),
held AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM texts),
times AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM times, totals GROUP BY term, docs),
impacts AS (
  SELECT r, doc_id, term,
         weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) AS impact
  FROM times JOIN weights USING (term), totals),
scores AS (
  SELECT q, item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


LINES = rf"""
WITH texts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r FROM documents),
every AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM texts),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), '{UPPER}', '{UPPER.lower()}') AS key
  FROM every),
repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
  HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN 1 END) >= 2),
judged AS (
  SELECT doc_id, r, i, line, repeated.key IS NOT NULL AND doc_id IS DISTINCT FROM first AS dropped
  FROM keyed LEFT JOIN repeated USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r"""
