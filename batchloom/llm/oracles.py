"""SQL that gives the rows of queries of this subpackage, for DuckDB."""

from __future__ import annotations

from batchloom.llm.secrets import LETTER_PAIRS
from batchloom.llm.url_filter import SUFFIXES

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOWER = "'abcdefghijklmnopqrstuvwxyz'"
_BLANK_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

CHAT = """WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS r,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS t FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + length('<|turn|>') + length('<|text|>') + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""

WARC = """WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages),
digests AS (SELECT *, sha1(p) AS h FROM payloads)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 1 + 5 * (j // 4), 5))::BIGINT >> (15 - 5 * (j % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM digests"""

_ALNUM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
places AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM places),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
doc_windows AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM doc_places),
hits AS (SELECT DISTINCT r, n, i, item_id FROM doc_windows JOIN item_windows USING (n, t)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (
  SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN found USING (r)"""

LINE_RULES = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    {_BLANK_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT r, source, text, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
line_words AS (SELECT r, source, text, line,
    {_BLANK_WORDS.format(f"translate(line, {_UPPER} || '123456789', {_LOWER} || '000000000')")} AS v FROM lines),
plain AS (SELECT r, source, text, array_to_string(v, ' ') AS key, len(v) AS n FROM line_words),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
common AS (SELECT source, key FROM plain GROUP BY source, key HAVING count(DISTINCT text) > 10),
removed AS (SELECT r, sum(n) AS gone FROM plain p JOIN common c ON p.key = c.key AND p.source IS NOT DISTINCT FROM c.source GROUP BY r),
places AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
windows AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS t FROM places),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM windows) WHERE c > 1),
again AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
figures AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(gone, 0)::BIGINT AS n_common_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN again USING (r) LEFT JOIN removed USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - n_common_words AS rest FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rest >= 10 AND rest >= 0.3 * n_words AS kept, n_common_words
FROM judged"""


def _level(name: str, keys: str, parent: str, on: str) -> str:
    """Posterior of one level of the host tree, given the one above."""
    source = f"(SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM nodes GROUP BY ALL) c, {parent} p" + (f" WHERE {on}" if on else "")
    columns = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""{name}_at AS (SELECT {columns}, c.n, c.bad, p.mean AS prior, p.weight AS behind FROM {source}),
{name}_rho AS (SELECT greatest(1 / 1001.0::DOUBLE, least(coalesce(
    sum(CASE WHEN n >= 2 THEN (bad - n * prior) ** 2 / n - prior * (1 - prior) END)
    / sum(CASE WHEN n >= 2 THEN prior * (1 - prior) * (n - 1) END), 0), 0.5)) AS rho FROM {name}_at),
{name}_s AS (SELECT *, least(1 / rho - 1, behind) AS strength FROM {name}_at, {name}_rho),
{name}s AS (SELECT * EXCLUDE (strength), (bad + strength * prior) / (n + strength) AS mean, n + strength AS weight FROM {name}_s)"""


_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES if s[0] not in "!*")
URL_FILTER = rf"""WITH urls AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_UPPER}, {_LOWER}) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
bare AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS site FROM urls),
split AS (SELECT *, string_split(site, '.') AS parts FROM bare),
ends AS (SELECT *, parts[-1] AS one, CASE WHEN len(parts) >= 2 THEN parts[-2] || '.' || parts[-1] END AS two FROM split),
cut AS (SELECT *, CASE WHEN regexp_matches(site, '^([0-9]+[.]){{3}}[0-9]+$|^\[') THEN site WHEN two = 'www.ck' THEN one
    WHEN two IN ({_SUFFIXES}) OR one = 'ck' AND two IS NOT NULL THEN two ELSE one END AS suffix FROM ends),
named AS (SELECT *, len(string_split(suffix, '.')) + 1 AS k FROM cut),
parsed AS (SELECT page_id, host, path, site, suffix,
    CASE WHEN len(parts) <= k THEN site ELSE array_to_string(parts[len(parts) - k + 1 :], '.') END AS domain FROM named),
marks AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
seen AS (SELECT suffix, domain, site, count(*) AS n, sum(bad) AS bad FROM parsed JOIN marks USING (page_id) GROUP BY ALL),
nodes AS (SELECT h.suffix, h.domain, h.site, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad
  FROM (SELECT DISTINCT suffix, domain, site FROM parsed) h LEFT JOIN seen USING (suffix, domain, site)),
root AS (SELECT (sum(bad) + 1) / (sum(n) + 2)::DOUBLE AS mean, sum(n) + 2 AS weight FROM nodes),
{_level("suffix", "suffix", "root", "")},
{_level("domain", "suffix, domain", "suffixs", "c.suffix = p.suffix")},
{_level("site", "suffix, domain, site", "domains", "c.suffix = p.suffix AND c.domain = p.domain")},
ruled AS (SELECT u.*, CASE
    WHEN (u.host = 'example.com' OR u.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (u.host = 'example.net' OR u.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (u.host = 'org' OR u.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (u.host = 'net' OR u.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) AS lower_bound
  FROM parsed u JOIN sites h ON u.site = h.site)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN lower_bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""

_NAMES = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)
_SECRETS = {
    "assign": rf"""(?:{_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "(AKIA[A-Z0-9]+)",
    "hex": "([0-9a-f]{32,})",
    "tokens": "([A-Za-z0-9+/_=-]{20,})",
}
_MATCHES = "\nUNION ALL ".join(
    f"""SELECT r, doc_id, source, '{kind}' AS kind, {place} AS place, string_split_regex(text, '{pattern}') AS gaps,
    regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', 1) AS parts FROM d"""
    for place, (kind, pattern) in enumerate(_SECRETS.items())
)

SECRETS = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
matched AS ({_MATCHES}),
each_match AS (SELECT r, doc_id, source, kind, place, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM matched WHERE len(hits) > 0),
placed AS (SELECT r, doc_id, source, kind, place, parts[i] AS value, hits[i] AS hit,
    length(array_to_string(gaps[1 : i], '')) + length(array_to_string(hits[1 : i - 1], '')) AS s FROM each_match),
measured AS (SELECT *, s + length(hit) AS e, length(value) AS n, list_distinct(string_split(value, '')) AS chars,
    regexp_full_match(value, '[0-9a-f]+|[0-9A-F]+') AS is_hex, length(regexp_replace(value, '[^A-Za-z]', '', 'g')) AS letters,
    length(value) - length(regexp_replace(lower(value), '{"|".join(LETTER_PAIRS)}', '', 'g')) AS paired FROM placed),
spans AS (SELECT *, regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND len(chars) >= 10
    AND list_sum(list_transform(chars, lambda c: (n - length(replace(value, c, ''))) * (n - length(replace(value, c, '')) - 1)))
      * CASE WHEN is_hex THEN 16 WHEN regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') THEN 62 ELSE 36 END
      <= 2 * n * (n - 1)
    AND (is_hex OR 100 * paired < 55 * letters) AS varied FROM measured),
good AS (SELECT * FROM spans WHERE CASE kind WHEN 'assign' THEN length(value) >= 8 WHEN 'access' THEN length(value) >= 16
  WHEN 'hex' THEN true ELSE varied END),
candidates AS (SELECT * FROM good g WHERE kind <> 'tokens' OR NOT EXISTS (
  SELECT 1 FROM good b WHERE b.r = g.r AND b.kind <> 'tokens' AND b.s < g.e AND g.s < b.e)),
holders AS (SELECT value, source, count(*) AS n FROM (SELECT DISTINCT value, source, doc_id FROM candidates) GROUP BY value, source),
owners AS (SELECT value, count(*) AS n_owners, sum(n) AS n_repos FROM holders GROUP BY value),
classed AS (SELECT c.*, CASE WHEN n_owners >= 3 THEN 'example' WHEN n_owners <= 1 AND n_repos <= 20 AND varied THEN 'live'
    ELSE 'unclear' END AS class
  FROM candidates c JOIN owners USING (value)),
shown AS (SELECT *, CASE WHEN kind = 'tokens' THEN 'owned' ELSE kind END || ':' || s || ':' || e AS t
  FROM classed WHERE kind <> 'tokens' OR class = 'live'),
per_doc AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(t, ',' ORDER BY s, place) FILTER (kind <> 'tokens') AS base, string_agg(t, ',' ORDER BY s, place) AS spans,
    count(*) FILTER (class = 'live') AS live, count(*) FILTER (class = 'example') AS example FROM shown GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, 0)::BIGINT AS n_live,
  coalesce(example, 0)::BIGINT AS n_example
FROM d LEFT JOIN per_doc USING (r)"""

RESAMPLING = rf"""WITH crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS of_byte),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS w FROM documents),
f AS (SELECT r, unnest(w) AS word FROM d),
b AS (SELECT unnest(w) AS word FROM (SELECT {_ALNUM_WORDS} AS w FROM benchmark)),
words AS (SELECT word FROM f UNION SELECT word FROM b),
bytes AS (SELECT word, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(word), (2 * i + 1)::BIGINT, 2))::BIGINT) AS l
  FROM words),
crc AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], l),
    lambda c, x: xor(c // 256, of_byte[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
s AS (SELECT bucket, count(*) AS n FROM f JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN crc USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT r, sum(gain) AS weight FROM f JOIN crc USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20
    ORDER BY weight + noise DESC, doc_id NULLS FIRST, r) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20
  AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed"""
