"""DuckDB SQL for the queries that SQL can express at the size that they are compared at."""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_mix_sources": """
WITH docs AS (SELECT *, coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, '')) AS key FROM documents),
sized AS (SELECT source, sum(length(coalesce(text, '')))::double AS size FROM docs GROUP BY source),
shared AS (SELECT source, size / sum(size) OVER () AS share FROM sized),
weighted AS (SELECT source, share, pow(share, 0.5) AS weight FROM shared),
rated AS (SELECT source, CASE WHEN share > 0 THEN round(weight / (SELECT sum(round(weight, 12)) FROM weighted) / share, 9) ELSE 1.0 END AS rate FROM weighted),
split AS (SELECT source, greatest(ceil(rate / 8), 1)::bigint AS chunks, rate / greatest(ceil(rate / 8), 1) AS mean FROM rated),
cdf AS (SELECT source, k, sum(exp(-mean) * pow(mean, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS upto FROM split CROSS JOIN (SELECT unnest(range(0, 64))::double AS k)),
drawn AS (SELECT d.*, j, cast('0x' || substr(md5(key || ':17:' || j::varchar), 1, 13) AS bigint) / 4503599627370496.0::double AS u
  FROM docs d JOIN split s ON d.source IS NOT DISTINCT FROM s.source CROSS JOIN LATERAL (SELECT unnest(range(1, s.chunks + 1)) AS j)),
counted AS (SELECT doc_id, key, any_value(d.source) AS source, any_value(lang) AS lang, any_value(n_chars) AS n_chars, any_value(text) AS text, count(c.k) AS n
  FROM drawn d LEFT JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.upto <= d.u GROUP BY doc_id, key)
SELECT doc_id, source, copy, cast('0x' || substr(md5(key || ':18:' || copy::varchar), 1, 13) AS bigint) / 4503599627370496.0::double AS place, lang, n_chars, text
FROM (SELECT *, unnest(range(0, n)) AS copy FROM counted)""",
    "op3_chat_format": """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, length('<|turn|>') + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;')) + 1
  + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + length('<|end|>') AS chars FROM turns),
said AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss, sum(chars)::bigint AS formatted_chars FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::bigint AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said""",
    "op9_quality_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
ws AS (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT rid, regexp_extract_all(text, {WORD}) AS w FROM docs)),
tri AS (SELECT rid, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM ws WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY rid),
raw AS (SELECT rid, source, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT rid, source, string_split(text, chr(10)) AS l FROM docs)),
lines AS (SELECT rid, source, i, line, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), {WORD}) AS w FROM raw WHERE regexp_matches(line, {WORD})),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
held AS (SELECT DISTINCT lines.source, docs.text, w FROM lines JOIN docs USING (rid)),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM docs GROUP BY source),
common AS (SELECT held.source, w FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source GROUP BY held.source, w HAVING count(*) > 20 AND 1000 * count(*) > 10 * any_value(hosts.n)),
gone AS (SELECT rid, sum(len(lines.w)) AS n FROM lines JOIN common ON lines.source IS NOT DISTINCT FROM common.source AND lines.w = common.w GROUP BY rid),
nums AS (SELECT rid, doc_id, len(regexp_extract_all(text, {WORD})) AS n_words, length(array_to_string(regexp_extract_all(text, {WORD}), '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM docs),
each AS (SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, coalesce(dups.n, 0)::bigint AS n_dup_lines, coalesce(covered.n, 0)::bigint AS n_repeat_words,
  (n_words - coalesce(gone.n, 0))::bigint AS n_left_words FROM nums LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_left_words < 50 AND 100 * n_left_words < 50 * n_words) AS kept FROM each""",
}
