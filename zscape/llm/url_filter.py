"""URL filters that follow redirects and canonical links.

Each page's URL is judged by rules of host and path; the longest rule that fits wins. Pages that no
rule fits get the decision of their aliases: redirect (``http-equiv=refresh``) and canonical-link
targets in the html are edges between URLs, and connected components over these edges carry decisions.
Explicit allow comes first: a component with an allowed URL is allowed, else one with a blocked URL is
blocked, else it is allowed as pages are by default. A page's own rule always stands.

Links are the ``href`` of each ``<link>`` whose ``rel`` has the word canonical and the target of each
``<meta http-equiv=refresh>``: every one of a page, with attributes in any order, quoted or not, and
character references of ASCII decoded; comments, scripts and styles hold no tags. Targets are resolved
as RFC 3986 says, against the page or its first ``<base href>``. Targets of another kind (``mailto:``,
``javascript:``) are no URLs here. Nodes are URLs without their fragment and without dot segments, with
the host in lower case, so copies of a URL share a node; targets count although they may be no page.

Null urls and urls without ``://`` have an empty host and path, fit no rule and have no links; null
html has no links; repeated rows get equal results; an empty table gives no rows; other columns are
never read; html of any length is read whole, by patterns that never step back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import evenly_joined, written
from .graph import connected_components

#: Verdict, host and path of each rule.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What no tag is read from, and then the tags with their attributes.
HIDDEN = r"(?is)<!--(?:-?+>|.*?(?:-->|--!>|\z))|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)"
TAG = rf"(?is)(<(?:link|meta|base)(?=[\s/])(?:[\s/]++|[^\s>/=]++(?:\s*+=\s*+{VALUE})?+|=)*+)"
ATTRIBUTE = rf"(?is)(?:[\s/]|(?<=[\"']))([^\s>/=]++)\s*+=\s*+({VALUE})"
#: The content of a refresh: seconds, then a semicolon, comma or space, then the target.
REFRESH = r"(?is)^\s*+(?:[0-9.]++(?:\s*+[;,]|\s++)|[;,]|(?=url\s*+=))\s*+(?:url\s*+=\s*+)?+(?:\"([^\"]*+)|'([^']*+)|([^\"'].*+))"
REFERENCE = r"&(?:#[0-9]{1,4}|#[xX][0-9A-Fa-f]{1,4});"
NAMED = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
#: The one form of link that SQL reads.
SQL_CANONICAL = (r"(?i)<link[^>]*rel=[\"']?canonical[\"']?[^>]*href=[\"']?([^\"'> ]+)", r"(?i)<link[^>]*href=[\"']?([^\"'> ]+)[\"']?[^>]*rel=[\"']?canonical")
SQL_REFRESH = r"(?i)<meta[^>]*http-equiv=[\"']?refresh[\"']?[^>]*content=[\"']?[0-9. ]*; *url=([^\"'> ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    found = [F.when(f, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for f, (v, h, p) in zip(fits, ordered)]
    return F.coalesce(*found, F.lit(None))


def _without_dots(path: Column) -> Column:
    """``path`` after its ``.`` and ``..`` segments are followed."""
    segments = F.split(path, "/")
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.lit(1), F.size(done) - 1))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array(F.lit("")), step)
    ends = F.when(path.rlike(r"/\.\.?$"), F.concat(F.array_join(kept, "/"), F.lit("/"))).otherwise(F.array_join(kept, "/"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), ends).otherwise(path)


def _scheme(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)


def node(url: Column) -> Column:
    """The URL without fragment and dot segments and with its host in lower case; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    return F.when(url.contains("://"), F.concat(_scheme(url), F.lit("://"), host(url), _without_dots(path(url)), query))


def resolved(target: Column, url: Column) -> Column:
    """``target`` as seen from the page at ``url``."""
    scheme = _scheme(url)
    root = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_replace(path(url), r"[^/]*$", "")
    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path(url), target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first(text: Column, pattern: str) -> Column:
    """The one of the pattern's three groups that took part."""
    return F.concat(*(F.regexp_extract(text, pattern, k) for k in (1, 2, 3)))


def _numeric(text: Column, ref: Column) -> Column:
    digits = F.regexp_extract(ref, "([0-9A-Fa-f]+);", 1)
    code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int")
    return F.when(code.between(32, 126), F.replace(text, ref, F.char(code))).otherwise(text)


def _decoded(value: Column) -> Column:
    """An attribute's value without its quotes and the space around, character references replaced."""

    def decoded(plain: Column) -> Column:
        out = F.aggregate(F.array_distinct(F.regexp_extract_all(plain, F.lit(REFERENCE), 0)), plain, _numeric)
        out = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), NAMED.items(), out)
        return F.regexp_replace(F.when(plain.contains("&"), out).otherwise(plain), r"[\t\n\r]|^[\x00-\x20]+|[\x00-\x20]+$", "")

    return _let(_first(value, r"(?s)^(?:\"(.*)\"|'(.*)'|(.*))$"), decoded)


def _tag(tag: Column) -> Column:
    """``link`` and ``base``: what a tag says, null where it says nothing of the kind."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), F.lower)
    values = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2), _decoded)

    def read(t: Column) -> Column:
        attribute = lambda name: F.get(t["values"], F.array_position(t["names"], name).cast("int") - 1)  # noqa: E731  the first of that name
        canonical = (t["kind"] == "link") & F.array_contains(F.split(F.lower(attribute("rel")), r"\s+"), "canonical")
        refresh = (t["kind"] == "meta") & (F.lower(attribute("http-equiv")) == "refresh")
        link = F.when(canonical, attribute("href")).when(refresh, F.trim(_first(attribute("content"), REFRESH)))
        return F.struct(F.nullif(link, F.lit("")).alias("link"), F.when(t["kind"] == "base", F.nullif(attribute("href"), F.lit(""))).alias("base"))

    return _let(F.struct(F.lower(F.substring(tag, 2, 4)).alias("kind"), names.alias("names"), values.alias("values")), read)


def edges(pages: DataFrame) -> DataFrame:
    """``src, dst``: the links of all canonical tags and redirects, between nodes."""
    said = pages.where("url IS NOT NULL AND html IS NOT NULL").where(F.col("html").rlike("(?i)canonical|refresh|&#"))
    tags = F.transform(F.regexp_extract_all(F.regexp_replace("html", HIDDEN, " "), F.lit(TAG), 1), _tag)
    said = said.select("url", tags.alias("tags"))
    said = said.select("url", F.get(F.filter(F.col("tags.base"), F.isnotnull), F.lit(0)).alias("base"), F.explode(F.array_distinct(F.filter(F.col("tags.link"), F.isnotnull))).alias("target"))
    said = said.select("url", "target", F.when(F.col("base").isNull(), F.col("url")).otherwise(resolved(F.col("base"), F.col("url"))).alias("base"))
    said = said.select("url", resolved(F.col("target"), F.col("base")).alias("target"))
    return said.select(node(F.col("url")).alias("src"), node(F.col("target")).alias("dst"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every page."""
    nodes = connected_components(edges(pages))
    own = rule_of(host(F.col("node")), path(F.col("node")), rules)
    said = nodes.withColumn("own", own).groupBy("component").agg(F.count("*").alias("n"), F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    alias = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise(default)
    known = evenly_joined(nodes, said.select("component", alias.alias("alias")), "component", said.select("component", "n"), F.xxhash64("node"))
    known = written(known.select("node", "component", "alias"), "aliases")
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"))  # null urls and a much repeated one are hot
    rows = evenly_joined(rows, known, "node", sizes, F.xxhash64("page_id"), how="left").withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias", F.lit(default)).alias("verdict"), "component")


def _sql() -> str:
    """The same in SQL for links of one form, with reachability by recursion (meant for small inputs)."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    h = f"coalesce(translate(regexp_extract(url, {quoted(SPLIT)}, 1), '{UPPER}', '{LOWER}'), '')"
    p = f"coalesce(regexp_extract(url, {quoted(SPLIT)}, 2), '')"
    scheme = "regexp_extract(url, '(?s)^(.*?)://', 1)"
    n = f"CASE WHEN contains(url, '://') THEN translate({scheme}, '{UPPER}', '{LOWER}') || '://' || {h} || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"
    found = ", ".join(f"regexp_extract(html, {quoted(x)}, 1)" for x in (*SQL_CANONICAL, SQL_REFRESH))
    root = f"{scheme} || '://' || {h}"
    folder = f"regexp_replace({p}, '[^/]*$', '')"
    return f"""
WITH RECURSIVE l AS (SELECT url, unnest([{found}]) AS target FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
e AS (SELECT {n} AS src, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN {scheme} || ':' || target
             WHEN starts_with(target, '/') THEN {root} || target ELSE {root} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || target END AS url FROM l WHERE target <> ''),
b AS (SELECT src, {n} AS dst FROM e),
s AS (SELECT src, dst FROM b WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM b WHERE src IS NOT NULL AND dst IS NOT NULL),
r AS (SELECT src AS node, src AS far FROM s UNION SELECT r.node, s.dst FROM r JOIN s ON r.far = s.src),
c AS (SELECT node, min(far) AS component FROM r GROUP BY 1 HAVING count(*) > 1),
v AS (SELECT component, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
      FROM (SELECT component, {case(lambda v, h, p: v)} AS verdict FROM (SELECT component, {h} AS host, {p} AS path FROM (SELECT component, node AS url FROM c))) GROUP BY 1),
g AS (SELECT page_id, {h} AS host, {p} AS path, {n} AS node FROM pages)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
       coalesce({case(lambda v, h, p: v)}, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict, component
FROM g LEFT JOIN c USING (node) LEFT JOIN v USING (component)
"""


ORACLE_SQL = _sql()
