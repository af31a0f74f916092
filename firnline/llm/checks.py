"""DuckDB text of the operators that SQL can express."""

from __future__ import annotations

from firnline.llm import decontam, mixing, quality, sharding, substrings, urls
from firnline.llm.text import CRC_TABLE_SQL, crc_sql

QUALITY = rf"""
WITH {CRC_TABLE_SQL},
d AS (SELECT doc_id, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
p AS (SELECT doc_id, i, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM p WHERE w3 IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, range(3) AS r(k) WHERE n > 1 GROUP BY doc_id),
code AS (SELECT w, {crc_sql('w')} AS h FROM (SELECT DISTINCT w FROM w), crc_table c),
cell AS (SELECT doc_id, h % {quality.BUCKETS} AS bucket FROM w JOIN code USING (w)
  UNION ALL SELECT doc_id, (a.h * 31 + b.h + 7) % {quality.BUCKETS} FROM p JOIN code a ON a.w = p.w JOIN code b ON b.w = p.w2),
idcode AS (SELECT v, {crc_sql('v')} AS h FROM (SELECT DISTINCT doc_id::VARCHAR AS v FROM labels WHERE doc_id IS NOT NULL), crc_table c),
trusted AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0)
  JOIN idcode ON v = doc_id::VARCHAR ORDER BY h, doc_id LIMIT {quality.MAX_TRUSTED}),
seen AS (SELECT bucket, count(*) AS raw, count(t.doc_id) AS good FROM cell LEFT JOIN trusted t USING (doc_id) GROUP BY bucket),
full_ AS (SELECT b AS bucket, coalesce(raw, 0) AS raw, coalesce(good, 0) AS good FROM range({quality.BUCKETS}) AS r(b) LEFT JOIN seen ON bucket = b),
model AS (SELECT bucket, round((ln((good + 1) / (tg + {quality.BUCKETS})) - ln((raw + 1) / (tr + {quality.BUCKETS}))) * 1e6)::BIGINT AS llr
  FROM full_, (SELECT sum(raw)::DOUBLE AS tr, sum(good)::DOUBLE AS tg FROM full_)),
s AS (SELECT doc_id, sum(llr)::BIGINT / (count(*) * 1e6) AS score FROM cell JOIN model USING (bucket) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(body, '{quality.SYMBOLS}'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, score
  FROM (SELECT *, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d
  LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id)),
t AS (SELECT 2 * quantile_cont(score, {quality.LOW_SHARE}) - quantile_cont(score, 0.5) AS t
  FROM f JOIN trusted USING (doc_id) WHERE n_words >= 50)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(score >= t, true) AS kept FROM f, t
"""


def unit_sql(*parts: str) -> str:
    text = " || ':' || ".join(f"coalesce(({p})::VARCHAR, '~')" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / {float(2 ** 52)!r})"


MIX = f"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0) + 16)::DOUBLE AS bytes FROM documents GROUP BY source),
r AS (SELECT source, pow(bytes, {mixing.POWER}) / sum(pow(bytes, {mixing.POWER})) OVER () * sum(bytes) OVER () / bytes AS rate FROM sizes),
q AS (SELECT source, rate, ceil(rate / {mixing.PART})::INT AS parts FROM r),
pk AS (SELECT source, parts, k, CASE WHEN k = 0 THEN exp(-rate / parts)
    ELSE exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) END AS p FROM q, range({mixing.STEPS + 1}) AS s(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pk),
u AS (SELECT doc_id, d.source, j, CASE WHEN parts = 1 THEN {unit_sql(str(mixing.SEED), 'doc_id', "'count'")}
    ELSE {unit_sql(str(mixing.SEED), 'doc_id', "'count'", 'j')} END AS u
  FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source, range(parts) AS s(j)),
n AS (SELECT doc_id, u.source, count(c) AS n FROM u LEFT JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND c <= u GROUP BY doc_id, u.source)
SELECT doc_id, source, n::INT AS n_copies, copy::INT AS copy,
  row_number() OVER (ORDER BY {unit_sql(str(mixing.SEED), 'doc_id', "'order'", 'copy')}, doc_id, copy) - 1 AS position
FROM n, range(1, n + 1) AS s(copy)
"""

_TOP = (1 << sharding.BITS) - 1
SHARDS = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, coalesce({crc_sql('text')}, 0) AS text_crc32,
    coalesce({crc_sql('lang')} & {_TOP}, 0) AS a, coalesce({crc_sql('source')} & {_TOP}, 0) AS b FROM documents, crc_table c),
e AS (SELECT *, least(2 * (length(bin(size)) - 5) + substr(bin(size), 2, 1)::INT, {_TOP})::BIGINT AS z FROM d),
turn AS (SELECT DISTINCT a, b, z, a AS x0, b AS x1, z AS x2, {1 << (sharding.BITS - 1)}::BIGINT AS q FROM e
  UNION ALL
  SELECT a, b, z, x0, x1, x2, q >> 1 FROM (
    SELECT a, b, z, q, CASE WHEN y2 & q > 0 THEN xor(y0, q - 1) ELSE xor(y0, xor(y0, y2) & (q - 1)) END AS x0, y1 AS x1,
      CASE WHEN y2 & q > 0 THEN y2 ELSE xor(y2, xor(y0, y2) & (q - 1)) END AS x2 FROM (
      SELECT a, b, z, q, x2 AS y2, CASE WHEN x1 & q > 0 THEN xor(w, q - 1) ELSE xor(w, xor(w, x1) & (q - 1)) END AS y0,
        CASE WHEN x1 & q > 0 THEN x1 ELSE xor(x1, xor(w, x1) & (q - 1)) END AS y1 FROM (
        SELECT *, CASE WHEN x0 & q > 0 THEN xor(x0, q - 1) ELSE x0 END AS w FROM turn WHERE q > 1)))),
gray AS (SELECT a, b, z, x0 AS g0, xor(x0, x1) AS g1, xor(xor(x0, x1), x2) AS g2 FROM turn WHERE q = 1),
flip AS (SELECT *, list_reduce([0::BIGINT] || list_transform(range(1, {sharding.BITS}), lambda i: CASE WHEN g2 & (1 << i) > 0 THEN (1 << i) - 1 ELSE 0 END),
    lambda m, n: xor(m, n)) AS f FROM gray),
ind AS (SELECT a, b, z, list_sum(list_transform(range({sharding.BITS}), lambda i:
    (((xor(g0, f) >> i) & 1) << (3 * i + 2)) + (((xor(g1, f) >> i) & 1) << (3 * i + 1)) + (((xor(g2, f) >> i) & 1) << (3 * i))))::BIGINT AS hilbert FROM flip),
p AS (SELECT *, row_number() OVER (ORDER BY hilbert, text_crc32, doc_id, size) - 1 AS pos, count(*) OVER () AS n FROM e JOIN ind USING (a, b, z)),
s AS (SELECT *, (pos * {sharding.SHARDS} // n)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard,
  (pos - (shard * n + {sharding.SHARDS - 1}) // {sharding.SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, hilbert FROM s
"""


REPEATS = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
win AS (SELECT doc_id, i, list_slice(words, i, i + {substrings.WINDOW - 1}) AS w FROM d, range(1, len(words) - {substrings.WINDOW - 2}) AS r(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM dup, range({substrings.WINDOW}) AS r(k) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


def _letter_words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_letter_words('text')} AS words FROM documents),
b AS (SELECT item_id, {_letter_words('text')} AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, t, list_slice(words, i, i + t - 1) AS w
  FROM (SELECT *, least(len(words), {decontam.WINDOW}) AS t FROM b WHERE len(words) > 0), range(1, len(words) - t + 2) AS r(i)),
dw AS (SELECT doc_id, i, t, list_slice(words, i, i + t - 1) AS w FROM d, (SELECT DISTINCT t FROM bw), range(1, len(words) - t + 2) AS r(i)),
hit AS (SELECT doc_id, i, t, item_id FROM dw JOIN bw USING (t, w)),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(t) AS r(k) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first_id FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""

_FIT = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h + p}'"
    for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
_K = urls.ORDER


def _level(k: int) -> str:
    """One more character of context: counts of the tails, of their contexts, and the blended probabilities."""
    blend = ", ".join(f"CASE WHEN all_{c} > 0 THEN (coalesce(n_{c}, 0) + kinds_{c} * p_{c}) / (all_{c} + kinds_{c}) ELSE p_{c} END AS p_{c}" for c in ("good", "bad"))
    return f"""t{k} AS (SELECT substr(gram, {_K + 1 - k}, {k + 1}) AS tail, sum(good) AS n_good, sum(bad) AS n_bad FROM counted WHERE good + bad > 0 GROUP BY 1),
c{k} AS (SELECT substr(tail, 1, {k}) AS context, sum(n_good) AS all_good, sum(n_bad) AS all_bad,
  count(*) FILTER (n_good > 0) AS kinds_good, count(*) FILTER (n_bad > 0) AS kinds_bad FROM t{k} GROUP BY 1),
p{k} AS (SELECT gram, {blend} FROM p{k - 1 if k else 's'} LEFT JOIN t{k} ON tail = substr(gram, {_K + 1 - k}, {k + 1})
  LEFT JOIN c{k} ON context = substr(gram, {_K + 1 - k}, {k}))"""


URLS = f"""
WITH {CRC_TABLE_SQL},
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{urls.PARTS}', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{urls.PARTS}', 2) AS path FROM pages),
r AS (SELECT *, host || path AS text, {_FIT} AS found FROM u),
x AS (SELECT text, count(*) FILTER (starts_with(found, 'allow ')) AS good, count(*) FILTER (starts_with(found, 'block ')) AS bad FROM r GROUP BY text),
y AS (SELECT x.*, {crc_sql('text')} % 4 = 2 AS calibrates FROM x, crc_table c),
g AS (SELECT text, good, bad, calibrates, substr('{urls.START * _K}' || text || '{urls.END}', i::INT, {_K + 1}) AS gram FROM y, range(1, length(text) + 2) AS s(i)),
counted AS (SELECT gram, sum(CASE WHEN calibrates THEN 0 ELSE good END)::BIGINT AS good, sum(CASE WHEN calibrates THEN 0 ELSE bad END)::BIGINT AS bad FROM g GROUP BY gram),
ps AS (SELECT gram, {1 / urls.SYMBOLS!r}::DOUBLE AS p_good, {1 / urls.SYMBOLS!r}::DOUBLE AS p_bad FROM counted),
{", ".join(_level(k) for k in range(_K + 1))},
s AS (SELECT text, good, bad, calibrates, sum(round((ln(p_good) - ln(p_bad)) * 1e6)::BIGINT)::BIGINT / (count(*) * 1e6) AS score
  FROM g JOIN p{_K} USING (gram) GROUP BY ALL),
st AS (SELECT floor(score * {urls.STEPS})::BIGINT AS step, sum(good) AS good, sum(bad) AS bad FROM s WHERE calibrates GROUP BY 1),
ga AS (SELECT step, coalesce(sum(bad) OVER w, 0) * sum(good) OVER () - coalesce(sum(good) OVER w, 0) * sum(bad) OVER () AS gain,
  least(sum(good) OVER (), sum(bad) OVER ()) AS least_ FROM st WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce((SELECT step / {float(urls.STEPS)!r} FROM ga WHERE least_ > 0 ORDER BY gain DESC, step LIMIT 1), 0) AS l)
SELECT page_id, host, path, CASE WHEN found IS NOT NULL THEN substr(found, 7) END AS rule,
  CASE WHEN found IS NOT NULL THEN substr(found, 1, 5) WHEN score >= l THEN 'allow' ELSE 'block' END AS verdict, score
FROM r JOIN s USING (text), l
"""
