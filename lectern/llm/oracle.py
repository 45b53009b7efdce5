"""DuckDB twins of the queries that SQL can express.

Patterns and limits are written out here on purpose: a wrong constant in an
operator must not be wrong on both sides.
"""

from __future__ import annotations

OP5 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
    SELECT row_id, doc_id, t,
           regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM docs
), lines AS (
    SELECT row_id, unnest(lines) AS line FROM parts
), tested AS (
    SELECT row_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS solid,
           length(regexp_replace(line, '[^!-/:-@\[-`{-~]', '', 'g')) AS marks,
           length(replace(line, ' | ', '--')) AS x1, length(replace(line, ' > ', '--')) AS x2,
           length(replace(line, ' » ', '--')) AS x3, length(replace(line, ' › ', '--')) AS x4,
           length(replace(line, ' · ', '--')) AS x5, length(replace(line, ' • ', '--')) AS x6
    FROM lines
), passed AS (
    SELECT row_id, sum(solid) AS solid FROM tested
    WHERE NOT (marks >= 4 AND 100 * marks > 20 * solid)
      AND regexp_matches(line, '[.!?…][)\]"''”»]*([\x20\x09-\x0D]|\z)|[。！？]')
      AND NOT (6 * length(line) - x1 - x2 - x3 - x4 - x5 - x6 >= 2
               AND 60 * (6 * length(line) - x1 - x2 - x3 - x4 - x5 - x6) >= length(line))
      AND trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') NOT IN (
          'home', 'menu', 'next', 'previous', 'login', 'log in', 'sign in', 'sign up', 'search', 'back to top', 'read more')
      AND NOT (length(line) <= 200 AND regexp_matches(
          translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          'all rights reserved|privacy policy|cookie policy|uses cookies|terms of (use|service)|(licensed|released) under|enable javascript|subscribe to our|powered by|copyright (©|\(c\))'))
    GROUP BY row_id
), places AS (
    SELECT row_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM parts
), spans AS (
    SELECT row_id, place, count(*) OVER w AS size, string_agg(word, ' ') OVER w AS span FROM places
    WINDOW w AS (PARTITION BY row_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), runs AS (
    SELECT row_id, place, count(*) OVER (PARTITION BY row_id, span) AS times FROM spans WHERE size = 8
), covered AS (
    SELECT row_id, count(DISTINCT word) AS n FROM (SELECT row_id, unnest(range(place, place + 8)) AS word FROM runs WHERE times > 1)
    GROUP BY row_id
), counted AS (
    SELECT p.row_id, doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(s.solid, 0) AS solid
    FROM parts p LEFT JOIN covered c USING (row_id) LEFT JOIN passed s USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
           AND NOT (100 * (word_chars - solid) > 50 * word_chars) AS kept
FROM counted
"""

OP10 = r"""
WITH parts AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules (rule_host, rule_path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), ruled AS (
    SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM (SELECT row_number() OVER () AS row_id, * FROM parts) LEFT JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY row_id, page_id, host, path
), hosts AS (
    SELECT host, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain, string_split(host, '.')[-1] AS suffix,
           count(verdict) AS n, count(*) FILTER (WHERE verdict = 'allow') AS good
    FROM ruled GROUP BY host
), domains AS (
    SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 0.5) / (sum(n) + 1.0) FROM hosts) AS mean
    FROM domains GROUP BY suffix
), s1 AS (
    SELECT sum(n * (good / n - mean) ** 2) AS dev, sum(mean * (1 - mean)) AS noise, sum(n * mean * (1 - mean)) AS total FROM suffixes WHERE n > 0
), t1 AS (
    SELECT least(greatest(CASE WHEN dev - noise <= 0 THEN 1000.0
                          ELSE greatest(total - noise, 1e-9) / (dev - noise) - 1 END, 1.0), 1000.0) AS s FROM s1
), top AS (
    SELECT suffix, (mean * s + good) / (s + n) AS mean FROM suffixes, (SELECT coalesce(s, 1000.0) AS s FROM t1)
), middle AS (
    SELECT domain, n, good, mean FROM domains JOIN top USING (suffix)
), s2 AS (
    SELECT sum(n * (good / n - mean) ** 2) AS dev, sum(mean * (1 - mean)) AS noise, sum(n * mean * (1 - mean)) AS total FROM middle WHERE n > 0
), t2 AS (
    SELECT least(greatest(CASE WHEN dev - noise <= 0 THEN 1000.0
                          ELSE greatest(total - noise, 1e-9) / (dev - noise) - 1 END, 1.0), 1000.0) AS s FROM s2
), shrunk AS (
    SELECT domain, (mean * s + good) / (s + n) AS mean FROM middle, (SELECT coalesce(s, 1000.0) AS s FROM t2)
), last AS (
    SELECT host, n, good, mean FROM hosts JOIN shrunk USING (domain)
), s3 AS (
    SELECT sum(n * (good / n - mean) ** 2) AS dev, sum(mean * (1 - mean)) AS noise, sum(n * mean * (1 - mean)) AS total FROM last WHERE n > 0
), t3 AS (
    SELECT least(greatest(CASE WHEN dev - noise <= 0 THEN 1000.0
                          ELSE greatest(total - noise, 1e-9) / (dev - noise) - 1 END, 1.0), 1000.0) AS s FROM s3
), posterior AS (
    SELECT host, mean * s + good AS a, (1 - mean) * s + n - good AS b FROM last, (SELECT coalesce(s, 1000.0) AS s FROM t3)
), bounds AS (
    SELECT host, a / (a + b) + 1.64 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS upper FROM posterior
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN round(upper, 9) >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN bounds USING (host)
"""

OP12 = r"""
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM (SELECT DISTINCT vec_id, v FROM usable WHERE vec_id % 100 = 0) q
    JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_rules": OP5, "op10_url_reputation": OP10, "op12_exact_top_k": OP12}
