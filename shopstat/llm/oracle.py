"""DuckDB SQL for the queries that SQL can express, written from the contracts."""

from __future__ import annotations

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

# Metric, numerator, denominator, scale, reach, high quantile and tail in percent, lower fence too.
_METRICS = [
    ("word_length", "word_chars", "n_words", 100, 4, 95, 0, True),
    ("symbols", "n_symbols", "word_chars", 10000, 3, 95, 20, False),
    ("dup_lines", "n_dup_lines", "n_lines", 10000, 3, 98, 100, False),
    ("repeats", "n_repeat_words", "n_words", 10000, 3, 95, 100, False),
]


def _quality() -> str:
    steps = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS metric, least({scale} * {a} // {b}, 10000) AS step FROM base "
        f"WHERE {b} > 0" for m, a, b, scale, *_ in _METRICS)
    highs = " ".join(f"WHEN '{m}' THEN {high}" for m, _, _, _, _, high, _, _ in _METRICS)
    tests = []
    for m, a, b, scale, reach, _, tail, low in _METRICS:
        step = f"least({scale} * {a} // {b}, 10000)"
        tests.append(f"""coalesce((SELECT {b} = 0 OR ({step} <= q75 + greatest({reach} * iqr, {tail} * tail // 100)
            {f'AND {step} >= q25 - {reach} * iqr' if low else ''})
            FROM fence q WHERE q.metric = '{m}' AND q.level = b.level
              AND q.lang IS NOT DISTINCT FROM (CASE WHEN b.level < 2 THEN b.lang END)
              AND q.source IS NOT DISTINCT FROM (CASE WHEN b.level = 0 THEN b.source END)), true)""")
    return f"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
grams AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
shown AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM grams),
hit AS (SELECT DISTINCT rid, i + d AS i FROM shown, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1),
rep AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM words),
base0 AS (
  SELECT doc_id, lang, source, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS wc,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM words JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
base AS (SELECT * EXCLUDE (wc), coalesce(wc, 0) AS word_chars,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base0),
steps AS ({steps}),
levels AS (
  SELECT 0 AS level, lang, source, metric, step FROM steps UNION ALL
  SELECT 1, lang, NULL, metric, step FROM steps UNION ALL SELECT 2, NULL, NULL, metric, step FROM steps),
sorted AS (SELECT level, lang, source, metric, count(*) AS n, list_sort(list(step)) AS s FROM levels GROUP BY ALL),
quart AS (SELECT level, lang, source, metric, n, s[(n + 3) // 4] AS q25, s[(3 * n + 3) // 4] AS q75,
  s[((CASE metric {highs} END) * n + 99) // 100] AS qh FROM sorted),
own AS (SELECT *, nullif(q75 - q25, 0) AS iqr0, nullif(qh - q75, 0) AS tail0 FROM quart),
fence AS (SELECT o.level, o.lang, o.source, o.metric, o.n, o.q25, o.q75, 
    coalesce(CASE WHEN coalesce(o.iqr0, o.tail0) IS NOT NULL THEN o.iqr0 WHEN coalesce(a.iqr0, a.tail0) IS NOT NULL THEN a.iqr0 ELSE b.iqr0 END, 0) AS iqr,
    coalesce(CASE WHEN coalesce(o.iqr0, o.tail0) IS NOT NULL THEN o.tail0 WHEN coalesce(a.iqr0, a.tail0) IS NOT NULL THEN a.tail0 ELSE b.tail0 END, 0) AS tail
  FROM own o LEFT JOIN own a ON o.level < 2 AND a.level = 1 AND a.metric = o.metric AND a.lang IS NOT DISTINCT FROM o.lang
  LEFT JOIN own b ON b.level = 2 AND b.metric = o.metric),
big AS (SELECT level, lang, source, max(n) AS n FROM quart GROUP BY ALL HAVING max(n) >= 100 OR level = 2),
leveled AS (SELECT base.*, CASE
    WHEN EXISTS (SELECT 1 FROM big WHERE big.level = 0 AND big.lang IS NOT DISTINCT FROM base.lang AND big.source IS NOT DISTINCT FROM base.source) THEN 0
    WHEN EXISTS (SELECT 1 FROM big WHERE big.level = 1 AND big.lang IS NOT DISTINCT FROM base.lang) THEN 1 ELSE 2 END AS level FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(tests)} AS kept
FROM leveled b"""


_URLS = """
WITH parts AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT max_by(rh || rp, length(rh) * 10000 + length(rp)) FROM rules WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT max_by(v, length(rh) * 10000 + length(rp)) FROM rules WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)), 'allow') AS verdict
FROM parts"""

# base32 of the SHA-1: five bits a digit
_WARC = """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html FROM pages),
bits AS (SELECT rid, list_aggregate(list_transform(string_split(sha1(html), ''),
    lambda d: (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])
      [strpos('0123456789abcdef', d)]), 'string_agg', '') AS b FROM p),
dig AS (SELECT rid, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT), 1)), 'string_agg', '') AS digest FROM bits),
o AS (SELECT p.*, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, rid) AS n,
    min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN least END AS refers_to, true AS intact
FROM o JOIN dig USING (rid)"""

_COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS p, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT * FROM f WHERE m > 1),
subs AS (SELECT DISTINCT lang, f, array_to_string(p[i:i + s - 1], ' ') AS phrase FROM (
    SELECT lang, f, p, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT lang, f, p, m, unnest(range(2, m)) AS s FROM cand WHERE m > 2))),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(p[1:k], ' ') AS x, array_to_string(p[k + 1:], ' ') AS y
    FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n, 1000 * c.a * n // (l.f * r.f) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y JOIN total t ON t.lang = c.lang),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM low c WHERE NOT EXISTS (SELECT 1 FROM subs s WHERE s.lang = c.lang AND s.phrase = c.phrase AND 100 * s.f >= 100 * c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": _quality(),
    "op9_warc": _WARC,
    "op10_url_filter": _URLS,
    "op12_collocations": _COLLOCATIONS,
}
