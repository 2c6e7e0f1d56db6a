"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
g AS (SELECT page_id, html, h, list_transform(range(8), lambda j: list_sum(list_transform(range(5), lambda k:
  (instr('0123456789abcdef', h[j * 5 + k + 1]) - 1) * (16 ** (4 - k))::BIGINT))::BIGINT) AS v FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM g JOIN f USING (html)
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {{'i': i, 's': array_to_string(w[i : i + k - 1], ' ')}})) AS x FROM d JOIN ks ON len(w) >= k),
hits AS (SELECT doc_id, pos.x.i AS i, pos.k AS k, item_id FROM pos JOIN win ON pos.x.s = win.s AND pos.k = win.k),
hitw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hitw USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
_HOST = _LOWER.format("regexp_extract(" + _REST + ", '(?s)^([^/?#]*)', 1)")
_PATH = "regexp_extract(" + _REST + ", '(?s)^[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_replace(regexp_replace('&' || regexp_extract(regexp_replace({0}, '(?s)#.*$', ''), '(?s)\\?(.*)$', 1), '&(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'gi'), '^&+|&+$', '', 'g')"
_NORMAL = "'~' || " + _HOST + " || regexp_replace(" + _PATH + ", '/+$', '') || CASE WHEN " + _QUERY + " <> '' THEN '?' || " + _QUERY + " ELSE '' END"
_PATTERNS = (
    r"""(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical["'']?[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)""",
    r"""(?is)<link\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b""",
    r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh["'']?[^>]*?\burl\s*=\s*["'']?([^"''\s>]+)""",
    r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["'']?og:url["'']?[^>]*?\bcontent\s*=\s*["'']?([^"''\s>]+)""",
)


def url_filter(rules: tuple[tuple[str, str, str], ...]) -> str:
    best = sorted(rules, key=lambda r: -(len(r[1]) + len(r[2])))
    fits = lambda h, p, host, path: f"({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}')"
    rule = lambda host, path: "CASE " + " ".join(f"WHEN {fits(h, p, host, path)} THEN '{h + p}'" for _, h, p in best) + " END"
    verdict = lambda host, path: "CASE " + " ".join(f"WHEN {fits(h, p, host, path)} THEN '{v}'" for v, h, p in best) + " END"
    found = " || ".join(f"regexp_extract_all(coalesce(html, ''), '{p}', 1)" for p in _PATTERNS)
    return f"""
WITH RECURSIVE base AS (SELECT page_id, url, html, {_HOST.format("coalesce(url, '')")} AS host, {_PATH.format("coalesce(url, '')")} AS path FROM pages),
pairs AS (SELECT DISTINCT url AS u, unnest([url] || list_filter({found}, lambda t: instr(t, '://') > 0)) AS t FROM base WHERE instr(url, '://') > 0),
edges AS (SELECT u AS a, {_NORMAL.format("u")} AS b FROM pairs UNION SELECT u, {_NORMAL.format("t")} FROM pairs UNION SELECT t, {_NORMAL.format("t")} FROM pairs),
ties AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS v, a AS r FROM ties UNION SELECT reach.v, ties.b FROM reach JOIN ties ON reach.r = ties.a),
names AS (SELECT u AS n FROM pairs UNION SELECT t FROM pairs),
ruled AS (SELECT n, {verdict(_HOST.format("n"), _PATH.format("n"))} AS v FROM names),
decided AS (SELECT reach.v AS n, min(ruled.v) AS v FROM reach JOIN ruled ON reach.r = ruled.n WHERE ruled.v IS NOT NULL GROUP BY reach.v)
SELECT page_id, host, path, {rule("host", "path")} AS rule, coalesce({verdict("host", "path")}, decided.v, 'allow') AS verdict
FROM base LEFT JOIN decided ON base.url = decided.n
"""
