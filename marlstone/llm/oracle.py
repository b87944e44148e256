"""DuckDB SQL for the queries that SQL can express, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from marlstone.llm import quality, secrets

_STOPS = ", ".join("'" + w + "'" for w in sorted(set(quality.STOP_WORDS)))
_ASSIGN = """'(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'""".replace("(?i:password|passwd|secret|token|api_?key)", secrets.ASSIGNED.partition(")")[0] + ")")

SQL = {
    "op2_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, text, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
per AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY skey) - 1) % 3 AS w FROM sized GROUP BY skey),
ahead AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, 3 * source_size / w AS reach FROM per),
prefix AS (
  SELECT *, coalesce(CAST(sum(3 * source_size) OVER (ORDER BY reach, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS held_before,
         CAST(sum(w) OVER (ORDER BY reach, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_rest FROM ahead),
held AS (
  SELECT *, reach <= (total - held_before) / w_rest AS is_held FROM prefix),
targets AS (
  SELECT skey, source_size,
         CASE WHEN is_held THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(w * (total - coalesce(CAST(sum(3 * source_size) FILTER (WHERE is_held) OVER () AS BIGINT), 0)) AS DOUBLE)
                   / CAST(sum(w) FILTER (WHERE NOT is_held) OVER () AS BIGINT) END AS target,
         CAST('0x' || substr(md5('mix:' || skey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM held),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY size, digest, md5(coalesce(text, ''))) AS k FROM sized JOIN targets USING (skey)),
planned AS (
  SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(k * target / source_size + u) - floor((k - 1) * target / source_size + u) END AS BIGINT) AS copies FROM ranked)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM planned
""",
    "op3_secret_scan": rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS body FROM documents),
cut AS (
  SELECT rid, source, lang, 0 AS kind, regexp_extract_all(body, {_ASSIGN}) AS m, regexp_extract_all(body, {_ASSIGN}, 2) AS v, string_split_regex(body, {_ASSIGN}) AS p FROM texts UNION ALL
  SELECT rid, source, lang, 1, regexp_extract_all(body, 'AKIA[A-Z0-9]+'), regexp_extract_all(body, 'AKIA[A-Z0-9]+'), string_split_regex(body, 'AKIA[A-Z0-9]+') FROM texts UNION ALL
  SELECT rid, source, lang, 2, regexp_extract_all(body, '[0-9a-f]+'), regexp_extract_all(body, '[0-9a-f]+'), string_split_regex(body, '[0-9a-f]+') FROM texts UNION ALL
  SELECT rid, source, lang, 3, regexp_extract_all(body, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(body, '[A-Za-z0-9+/_=-]+'), string_split_regex(body, '[A-Za-z0-9+/_=-]+') FROM texts),
rows_ AS (
  SELECT rid, source, lang, kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(p[1:len(m)]) AS gap FROM cut WHERE len(m) > 0),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM rows_),
counted AS (
  SELECT rid, source, lang, kind, stop - length(m) AS start, stop, v FROM placed
  WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN length(v) >= 20 WHEN 2 THEN length(v) >= 24
             ELSE length(v) >= 20 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') END),
owners AS (
  SELECT v, count(DISTINCT coalesce('=' || source, '~')) AS n_owners, count(DISTINCT coalesce('=' || source, '~') || coalesce('/=' || lang, '/~')) AS n_repos FROM counted GROUP BY v),
judged AS (
  SELECT c.*, n_owners <= 2 AND n_repos <= 4 AS owned,
         EXISTS (SELECT 1 FROM counted b WHERE b.rid = c.rid AND b.kind < 3 AND b.start < c.stop AND c.start < b.stop) AS covered
  FROM counted c JOIN owners USING (v)),
kept AS (
  SELECT rid, kind, start, owned, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS span FROM judged WHERE kind < 3 OR (owned AND NOT covered))
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans,
       count(*) FILTER (WHERE owned) AS n_owned, count(*) FILTER (WHERE NOT owned) AS n_shared
FROM texts LEFT JOIN kept USING (rid) GROUP BY rid, doc_id
""",
    "op4_line_dedup": r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS spot, unnest(lines) AS line FROM split),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS pos FROM places WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (
  SELECT doc_id, pos, line AS l1, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3 FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
ordered AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS copy FROM runs WHERE l3 IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM ordered, (VALUES (0), (1), (2)) AS o(j) WHERE copy > 1),
marked AS (
  SELECT p.doc_id, p.spot, p.line, w.pos IS NOT NULL AS is_worded, g.pos IS NOT NULL AS is_gone
  FROM places p LEFT JOIN worded w ON w.doc_id = p.doc_id AND w.spot = p.spot LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos)
SELECT doc_id, CAST(count(*) FILTER (WHERE is_worded) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE is_gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (WHERE NOT is_gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op6_ngram_jaccard": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM split),
sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = split.doc_id), doc_id)) AS component_id
FROM split LEFT JOIN sizes USING (doc_id)
""",
    "op7_window_dedup": r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE least < doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM later),
words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM split),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)
""",
    "op8_quality_rules": rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
split AS (
  SELECT rid, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM base),
places AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3),
windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM places JOIN split USING (rid)),
covered AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat FROM windows, (VALUES (0), (1), (2)) AS o(j) WHERE n >= 2 GROUP BY rid),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(words, lambda w: lower(w) IN ({_STOPS}))) AS BIGINT) AS n_stop_words
  FROM split LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         1000 * word_chars < 2000 * n_words OR 1000 * word_chars > 15000 * n_words AS fails_mean_word_length,
         1000 * n_symbols > 100 * n_words AS fails_symbols_to_words,
         1000 * n_stop_words < 50 * n_words AS fails_stop_words_to_words,
         1000 * n_dup_lines > 400 * n_lines AS fails_dup_lines_to_lines FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (fails_mean_word_length OR fails_symbols_to_words OR fails_stop_words_to_words OR fails_dup_lines_to_lines) AS kept,
       n_lines, n_stop_words, fails_mean_word_length, fails_symbols_to_words, fails_stop_words_to_words, fails_dup_lines_to_lines
FROM judged
""",
}
