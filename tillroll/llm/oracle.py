"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

from tillroll.llm import audit, mixing, quality, suffix_dedup, url_cascade, warc
from tillroll.llm.queries import THIN_PAGE_BYTES

_WORD = r"[^\x20\x09-\x0D]+"


def _op1() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(
        {x for ws in quality.STOP_WORDS.values() for x in ws.split()}))
    metrics = {
        "mean_word_chars": "word_chars / n_words",
        "symbol_ratio": "n_symbols / n_words",
        "stop_word_ratio": "n_stop / n_words",
        "dup_line_ratio": "CASE WHEN n_lines = 0 THEN 0.0 ELSE n_dup_lines / n_lines END",
        "ellipsis_line_ratio": "CASE WHEN n_lines = 0 THEN 0.0 ELSE n_ellipsis / n_lines END",
        "bullet_line_ratio": "CASE WHEN n_lines = 0 THEN 0.0 ELSE n_bullet / n_lines END",
        "letter_word_ratio": "n_letter / n_words",
    }
    limits = []
    for name, low, high in quality.RULES:
        expr = f"(CASE WHEN n_words = 0 THEN 0.0 ELSE {metrics[name]} END)"
        limits += [f"{expr} >= {low}"] if low is not None else []
        limits += [f"{expr} <= {high}"] if high is not None else []
    n = quality.WINDOW
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{_WORD}')) AS l,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + {n - 1}], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM d WHERE len(w) >= {n})),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest(range({n})) AS k) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣◦]'))) AS n_bullet
  FROM d LEFT JOIN rep USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed,
       NOT failed AND {' AND '.join(limits)} AS kept
FROM (SELECT *, n_words < {quality.MIN_WORDS}
             OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS failed FROM m)"""


def _fill(items: str, by: str, total: str, weight: str, cap: str, out: str) -> str:
    """SQL of min(cap, c x weight) with group sums of ``total``."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
  SELECT * EXCLUDE (lv, caps, rest, is_full, used, free),
         CASE WHEN is_full THEN {cap} ELSE least({cap}, ({total} - used) / free * {weight}) END AS {out}
  FROM (SELECT *, coalesce(sum(CASE WHEN is_full THEN {cap} END) OVER ({part}), 0.0) AS used,
               sum(CASE WHEN NOT is_full THEN {weight} END) OVER ({part}) AS free
        FROM (SELECT *, caps + lv * rest <= {total} AS is_full
              FROM (SELECT *, sum({cap}) OVER ({part} ORDER BY lv) AS caps,
                           sum({weight}) OVER ({part}) - sum({weight}) OVER ({part} ORDER BY lv) AS rest
                    FROM (SELECT *, {cap} / {weight} AS lv FROM {items}))))"""


def _op2() -> str:
    m = mixing.Mix()
    weights = ", ".join(f"{w}.0::DOUBLE" for w in m.weights)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         (('0x' || substr(md5('{m.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
           / {float(2 ** 52)}::DOUBLE AS u
  FROM documents),
s AS (SELECT *, CASE WHEN size >= 1000 THEN 4 WHEN size >= 100 THEN 3 WHEN size >= 10 THEN 2 ELSE 1 END AS level FROM d),
g AS (SELECT source, level, sum(size)::BIGINT AS level_size FROM s GROUP BY ALL),
src0 AS (SELECT source, sum(level_size)::BIGINT AS source_size FROM g GROUP BY ALL),
src1 AS (SELECT *, [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(m.weights)} + 1)::INT] AS weight,
                source_size * {m.cap}::DOUBLE AS cap,
                (sum(source_size) OVER ())::BIGINT * {m.share}::DOUBLE AS total FROM src0),
src AS ({_fill('src1', '', 'total', 'weight', 'cap', 'target')}),
lev0 AS (SELECT g.source, level, level_size, source_size, target, (level * level_size)::DOUBLE AS lweight,
                level_size * {m.cap}::DOUBLE AS lcap
         FROM g JOIN src ON g.source IS NOT DISTINCT FROM src.source WHERE level_size > 0),
lev1 AS ({_fill('lev0', 'source', 'target', 'lweight', 'lcap', 'lwords')}),
lev AS (SELECT *, copies - whole AS p, target - sum(whole * level_size) OVER (PARTITION BY source) AS remaining
        FROM (SELECT *, floor(copies)::BIGINT AS whole FROM (SELECT *, lwords / level_size AS copies FROM lev1))),
k AS (SELECT s.*, whole, remaining, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS key
      FROM s JOIN lev ON s.source IS NOT DISTINCT FROM lev.source AND s.level = lev.level WHERE size > 0),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto,
             sum(size) OVER (PARTITION BY source, key) AS unit FROM k WHERE key IS NOT NULL),
t AS (SELECT r FROM c WHERE upto::DOUBLE - unit / 2.0::DOUBLE <= remaining)
SELECT s.doc_id, s.size, src.source_size, src.target,
       (s.size * (coalesce(k.whole, 0) + CASE WHEN t.r IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM s JOIN src ON s.source IS NOT DISTINCT FROM src.source
LEFT JOIN k USING (r) LEFT JOIN t USING (r)"""


def _op10() -> str:
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    order = sorted(url_cascade.RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = {r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
            for r in order}
    rule = " ".join(f"WHEN {fits[r]} THEN '{r[0]}{r[1]}'" for r in order)
    verdict = " ".join(f"WHEN {fits[r]} THEN '{r[2]}'" for r in order)
    return rf"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {az}) AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
thin AS (SELECT DISTINCT host || path AS key FROM p WHERE bytes < {THIN_PAGE_BYTES})
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN host || path IN (SELECT key FROM thin) THEN 'block' ELSE 'allow' END AS verdict
FROM p"""


def _op8() -> str:
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes,
                  sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, max(page_id) AS first_id FROM p WHERE bytes >= {warc.MIN_REVISIT}
      GROUP BY digest HAVING count(*) > 1)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)"""


def _op11() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = f"""
  SELECT r, w, unnest(w) AS g FROM {{0}}
  UNION ALL
  SELECT r, w, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM {{0}})"""
    return rf"""
WITH RECURSIVE digit AS (SELECT b::UINTEGER AS b, b::UINTEGER AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1
  FROM digit WHERE k < 8),
tbl AS (SELECT list(c ORDER BY b) AS t FROM digit WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
dg AS (SELECT r, g FROM ({grams.format('d')})),
bg AS (SELECT r, g FROM ({grams.format('b')})),
keys AS (SELECT DISTINCT g FROM (SELECT g FROM dg UNION ALL SELECT g FROM bg)),
hashed AS (
  SELECT g, xor(list_reduce(list_transform(range(octet_length(encode(g))),
             lambda i: ('0x' || hex(encode(g)[i + 1:i + 1]))::UINTEGER),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INTEGER + 1]), 4294967295::UINTEGER),
         4294967295::UINTEGER) % 10000 AS bucket
  FROM keys, tbl),
s AS (SELECT bucket, count(*) AS n FROM dg JOIN hashed USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bg JOIN hashed USING (g) GROUP BY bucket),
gains AS (
  SELECT z.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dg) + 10000)::DOUBLE
      / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bg) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket FROM range(10000) z(bucket)) z LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (SELECT r, count(*) AS n, sum(gain) AS total
         FROM dg JOIN hashed USING (g) JOIN gains USING (bucket) GROUP BY r),
w AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
             CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
             ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE AS h
      FROM d LEFT JOIN sums USING (r)),
sc AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM w),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN rank <= 25 * (SELECT count(*) FROM rk) // 100 THEN rank END::BIGINT AS rank
FROM sc LEFT JOIN rk USING (r)"""


def _op12() -> str:
    n = suffix_dedup.LEAST
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS id, doc_id,
                  encode(coalesce(text, '')) AS x FROM documents),
p AS (SELECT r, id, p, md5(x[p + 1:p + {n}]) AS s
      FROM (SELECT r, id, x, unnest(range(octet_length(x) - {n - 1})) AS p FROM d)),
f AS (SELECT s, min(id) AS first FROM p GROUP BY s HAVING min(id) < max(id)),
hit AS (SELECT r, p FROM p JOIN f USING (s) WHERE id > first),
runs AS (SELECT r, g, min(p) AS a, max(p) + {n} AS z
         FROM (SELECT r, p, sum(CASE WHEN p - prev <= {n} THEN 0 ELSE 1 END)
                            OVER (PARTITION BY r ORDER BY p) AS g
               FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS prev FROM hit))
         GROUP BY r, g),
cuts AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS removed FROM runs GROUP BY r),
k AS (SELECT *, [0] || coalesce(z, []) AS s, coalesce(a, []) || [octet_length(x)] AS e
      FROM d LEFT JOIN cuts USING (r))
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
       coalesce(len(a), 0)::BIGINT AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(s) + 1),
              lambda i: hex(CASE WHEN e[i] > s[i] THEN x[s[i] + 1:e[i]] ELSE ''::BLOB END)), ''))) AS kept_sha256
FROM k"""


def _op13() -> str:
    words = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"
    steps = ", ".join(f"('{o}', {s}, {b}, {p})" for o, s, b, p in audit.orders("ABCDE"))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {words} AS w FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask
  FROM d JOIN f USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
s(filter_order, step, bit, before) AS (VALUES {steps}),
x AS (SELECT *, (mask & bit) <> 0 AS fails, (mask & before) <> 0 AS early FROM c, s),
y AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE NOT fails AND NOT early), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE fails AND NOT early), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE fails AND early), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails AND NOT early), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE fails AND NOT early), 0) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM y"""


ORACLE = {
    "op1_quality_rules": _op1(),
    "op2_source_mixing": _op2(),
    "op8_warc_salvage": _op8(),
    "op10_url_filter": _op10(),
    "op11_importance_resampling": _op11(),
    "op12_suffix_dedup": _op12(),
    "op13_filter_audit": _op13(),
}
