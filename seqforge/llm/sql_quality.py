"""DuckDB SQL for the quality rules, written from their definition."""

from __future__ import annotations

from . import quality

_CASES = ", ".join(f"('{rule}', {i}, {cut})" for rule, grid in quality.RULES.items() for i, cut in enumerate(grid))
_SHARES = ", ".join(quality.RULES)
_RISK = quality.ALPHA / len(quality.RULES)
_LEVEL = quality.DELTA / (len(quality.RULES) * (len(quality.STRATA) + 1))

#: CTEs up to ``verdict``: doc_id, the base signals, base_failed, kept, stratum.
CTES = rf"""
raw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM raw),
grams AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM parts WHERE len(words) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
base AS (SELECT p.rid, doc_id, t, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
                coalesce(n, 0)::BIGINT AS n_repeat_words,
                length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS caps, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks
         FROM parts p LEFT JOIN covered c ON p.rid = c.rid),
signals AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
                   CASE WHEN n_words <= 50 THEN 0 WHEN n_words <= 200 THEN 1 WHEN n_words <= 1000 THEN 2 ELSE 3 END AS stratum,
                   CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_share,
                   CASE WHEN n_words > 0 THEN marks::DOUBLE / n_words ELSE 0 END AS mark_share,
                   CASE WHEN word_chars > 0 THEN caps::DOUBLE / word_chars ELSE 0 END AS caps_share,
                   CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
                   CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share FROM base),
long AS (UNPIVOT signals ON {_SHARES} INTO NAME rule VALUE share),
grid(rule, step, cutoff) AS (VALUES {_CASES}),
clean AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
holdout AS (SELECT DISTINCT t, stratum, rule, share FROM long WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM clean)),
cells AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE share > cutoff) AS k FROM holdout JOIN grid USING (rule) GROUP BY ALL),
terms AS (SELECT stratum, rule, step, cutoff, n, k, unnest(range(0, k + 1)) AS i FROM cells WHERE k <= n * {_RISK}),
tested AS (SELECT stratum, rule, step, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK}))) <= {_LEVEL} AS ok
           FROM terms GROUP BY ALL),
limits AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM
             (SELECT g.stratum, g.rule, g.step, g.cutoff, bool_and(coalesce(ok, false)) OVER (PARTITION BY g.stratum, g.rule ORDER BY g.step) AS so_far
              FROM cells g LEFT JOIN tested t ON g.stratum = t.stratum AND g.rule = t.rule AND g.step = t.step) WHERE so_far GROUP BY ALL),
fired AS (SELECT DISTINCT rid FROM long JOIN limits USING (stratum, rule) WHERE share > cutoff),
verdict AS (SELECT rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                   (NOT base_failed AND rid NOT IN (SELECT rid FROM fired)) AS kept, stratum::INTEGER AS stratum FROM signals)
"""

ORACLE = f"WITH {CTES} SELECT * EXCLUDE (rid) FROM verdict"
