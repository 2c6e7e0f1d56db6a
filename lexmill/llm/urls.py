"""URL filter with redirect equivalence, as DataFrame expressions throughout.

A rule (host and path) fits its host and all subdomains where the url's path starts with the rule's; the longest wins.
Urls that no rule fits take the decision of their equivalence class: connected components over links between a page's
url and its redirect and canonical targets (meta refresh, link rel=canonical, og:url) and its normal form (fragment and
tracking parameters dropped). A class is blocked if a member is blocked by rule and none is allowed by rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.graph import connected_components
from lexmill.llm.runtime import materialise

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TRACKING = "(?i)&(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls where none fits; of equally long ones the last in order wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def normal_form(url: Column) -> Column:
    """The url without scheme, fragment, tracking parameters and closing slash, the host lower-cased."""
    host, path = host_path(url)
    query = F.regexp_extract(F.regexp_replace(url, "(?s)#.*$", ""), "(?s)\\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), TRACKING, ""), "^&+|&+$", "")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
_BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def _whole(ref: Column, base: Column) -> Column:
    """``ref`` as a whole url, resolved against the whole url ``base`` (RFC 3986); null for other schemes such as mailto."""
    scheme, root = F.regexp_extract(base, f"({_SCHEME})//", 1), F.regexp_extract(base, "(?s)^([^:/?#]*://[^/?#]*)", 1)
    own, asked = F.regexp_extract(base, "(?s)^[^:/?#]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(ref, "(?s)^[^?#]*(.*)$", 1)
    given = F.regexp_extract(ref, "(?s)^([^?#]*)", 1)
    start = F.when(given.startswith("/"), F.lit("")).otherwise(F.concat(F.regexp_replace(own, "[^/]*$", ""), F.when(own == "", F.lit("/")).otherwise(F.lit(""))))
    steps = F.split(F.substring(F.concat(start, given), 2, 1 << 30), "/")
    climb = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), climb)
    last = F.when(given.rlike("(?:^|/)[.]{1,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    path = F.concat(F.lit("/"), F.array_join(kept, "/"), last)
    return (
        F.when(ref.rlike(_SCHEME + "//"), ref)
        .when(ref.rlike(_SCHEME), F.lit(None))
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(given == "", F.when(asked.startswith("?"), F.concat(root, own, asked)).otherwise(F.regexp_replace(base, "(?s)#.*$", "")))
        .otherwise(F.concat(root, path, asked))
    )


def targets(html: Column, url: Column) -> Column:
    """Whole urls that the page at ``url`` names as its canonical or redirect address.

    Relative ones are resolved against the page's base, ``&amp;`` is read as ``&``, and attributes may come in any order.
    """
    found = F.concat(
        F.regexp_extract_all(html, F.lit(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"""(?is)<link\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*\brel\s*=\s*["']?canonical\b"""), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*?\burl\s*=\s*["']?([^"'\s>]+)["']?[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']?og:url["']?[^>]*?\bcontent\s*=\s*["']?([^"'\s>]+)"""), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*?\bcontent\s*=\s*["']?([^"'\s>]+)["']?[^>]*\bproperty\s*=\s*["']?og:url\b"""), F.lit(1)),
    )
    read = lambda u: F.regexp_replace(u, "&(?:amp|#0*38|#[xX]0*26);", "&")
    own = F.regexp_extract(html, _BASE, 1)
    base = F.when(own != "", F.coalesce(_whole(read(own), url), url)).otherwise(url)
    worth = html.rlike("(?i)canonical|refresh|og:url")
    whole = F.array_distinct(F.array_compact(F.transform(found, lambda u: _whole(read(u), base))))
    return F.when(worth, whole).otherwise(F.array().cast("array<string>"))


def _node(url: Column) -> Column:
    return F.xxhash64(url)


def alias_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(node, verdict) for urls whose class holds a ruled url beside others: block, or allow where any member is allowed."""
    linked = pages.where(F.instr(F.col(url_col), "://") > 0).select(F.col(url_col).alias("u"), targets(F.coalesce(F.col(html_col), F.lit("")), F.col(url_col)).alias("t"))
    ends = linked.select("u", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("t"))).alias("t"))
    # each url is tied to its normal form, each target to its own
    normal = lambda c: F.concat(F.lit("~"), normal_form(c))
    pairs = ends.select(F.col("u"), F.coalesce(F.col("t"), F.col("u")).alias("t"))
    edges, _ = materialise(
        pairs.select("u", "t").distinct().select(F.explode(F.array(
            F.struct(_node(F.col("u")).alias("src"), _node(normal(F.col("u"))).alias("dst"), F.col("u").alias("name")),
            F.struct(_node(F.col("u")).alias("src"), _node(normal(F.col("t"))).alias("dst"), F.col("t").alias("name")),
            F.struct(_node(F.col("t")).alias("src"), _node(normal(F.col("t"))).alias("dst"), F.col("t").alias("name")),
        )).alias("e")).select("e.src", "e.dst", "e.name").distinct(),
        "url-edges",
    )
    rule, verdict = judge(*host_path(F.col("name")), rules)
    ruled = edges.select(_node(F.col("name")).alias("vertex"), verdict.alias("v")).where("v is not null").distinct()
    labels = connected_components(edges.select("src", "dst").distinct(), small=0)  # in rounds to the end: no Python
    decided = labels.join(ruled, "vertex").groupBy("component").agg(F.min("v").alias("verdict"))  # allow before block
    return labels.join(decided, "component").select(F.col("vertex").alias("node"), "verdict")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict) of each row; the verdict is block or allow.

    Null urls and urls without ``://`` have an empty host and path, no rule, no alias, and are allowed. Rows repeat as
    they come; null html names no targets; an empty table gives no rows. Class members are told apart by 64-bit hashes.
    """
    host, path = host_path(F.col(url_col))
    rule, verdict = judge(F.col("host"), F.col("path"), rules)
    judged = pages.select(id_col, F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    judged = judged.withColumns({"rule": rule, "_own": verdict})
    aliases = alias_verdicts(pages, rules, url_col, html_col).where("verdict = 'block'")
    open_rows = judged.withColumn("_node", F.when(F.col("rule").isNull() & (F.col("host") != ""), _node(F.col("_url"))))
    told = open_rows.where("_node is not null").join(aliases, F.col("_node") == F.col("node"), "left")
    columns = [id_col, "host", "path", "rule"]
    by_alias = told.select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    return by_alias.union(open_rows.where("_node is null").select(*columns, F.coalesce("_own", F.lit("allow")).alias("verdict")))
