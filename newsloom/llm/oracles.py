"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat_format import BEGIN, END, MIDDLE
from .quality_rules import RULES

_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH line AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_TRIM}), '{_UPPER}', '{_LOWER}') AS key FROM line
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_ESC = r"regexp_replace(coalesce({0}, ''), '([\\<])', '\1\\', 'g')"

OP7 = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(BEGIN) + len(MIDDLE) + len(END)} + length({_ESC.format('role')}) + length({_ESC.format('text')}))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""

_WORDS = r"""
w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents)
)
"""

OP3 = rf"""
WITH {_WORDS}, tri AS (
  SELECT doc_id, pos, word, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), rep AS (
  SELECT doc_id, pos, length(word) AS n, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c) > 1 AS again FROM tri
), covered AS (
  SELECT doc_id, n, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM rep
), words AS (
  SELECT doc_id, count(*) AS n_words, sum(n)::BIGINT AS word_chars, sum(hit)::BIGINT AS n_repeat_words FROM covered GROUP BY 1
), line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), m AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')) AS n_lower, length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) AS n_exclaims
  FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id)
), f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (5 * n_dup_lines > 2 * n_lines)::BIGINT
    + 16 * (n_upper > 2 * n_lower AND n_upper > 100)::BIGINT + 32 * (2 * n_exclaims > n_words)::BIGINT + 64 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT)::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failures = 0 AS kept, failures FROM f
"""

ABLATIONS = rf"""
WITH o AS ({OP3}), r AS (SELECT * FROM (VALUES {', '.join(f"('{name}', {1 << k}::BIGINT)" for k, (name, _) in enumerate(RULES))}) AS t(rule, bit))
SELECT rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures = bit) AS n_only, count(*) FILTER (failures & ~bit <> 0) AS n_rejected_without FROM o, r GROUP BY 1
"""

OP6 = rf"""
WITH {_WORDS}, windows AS (
  SELECT doc_id, pos, word, list(word) OVER f AS key, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), placed AS (
  SELECT doc_id, pos, word, n = 20 AND row_number() OVER (PARTITION BY n = 20, key ORDER BY doc_id, pos) > 1 AS later FROM windows
), covered AS (
  SELECT doc_id, pos, word, max(later::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM placed
)
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN covered c ON c.doc_id = d.doc_id GROUP BY 1
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1, "op3_quality_rules": OP3, "op6_substring_dedup": OP6, "op7_chat_formatting": OP7, "quality_ablations": ABLATIONS,
}
