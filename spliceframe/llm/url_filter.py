"""URL rules, and block decisions that spread over redirect and canonical-link aliases.

A page is judged by the longest rule that fits its host and path. Pages without a rule get their verdict from their aliases: URLs joined
by redirects (meta refresh) and canonical links, all that a page has outside comments and scripts, form components; in one with an allowed page, allow; else in one with a blocked page, block;
else allow. A page's own rule always comes first, and an explicit allow comes before any block that reaches it over aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.llm.common import Workspace, ascii_lower
from spliceframe.llm.components import connected_components

#: Host and its subdomains, path prefix, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Comments, scripts and styles, which hold no tags, and the tags that matter: a '>' within quotes ends none.
TAGS = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<(?:link|meta|base)\b[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
#: An attribute with its value, if it has one; names; values behind names.
ATTRIBUTES = r"""(?s)[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
NAME, VALUE = r"""(?s)^([^\s"'>/=]+)""", r"""(?s)^[^=]*=\s*(.*)$"""
#: Where a refresh goes: behind url=, or behind the seconds alone; in quotes up to the next one.
REFRESH = r"""(?is)^\s*(?:(?:[0-9.]+\s*[;,]?\s*)?url\s*=\s*|[0-9.]+(?:\s*[;,]\s*|\s+))(?:"([^"]*).*|'([^']*).*|(.*?))\s*$"""
#: Entities that are decoded, &amp; last, so that nothing is decoded twice.
ENTITIES = tuple((rf"(?i)&{name};|&#(?:0*{dec}|x0*{code});", char) for name, dec, code, char in (("lt", 60, "3c", "<"), ("gt", 62, "3e", ">"), ("quot", 34, "22", '"'), ("apos", 39, "27", "'"), ("amp", 38, "26", "&")))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What an alias is known by: host, path and query, without scheme and fragment; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def own_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, by code points of host and path together; null if none does. Ties: the earlier rule."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _decoded(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.regexp_replace(c, entity, char)
    return c


def _attribute(attributes: Column, name: str) -> Column:
    """The decoded value of a tag's first attribute of a name, without white space around it; null if it has none or it is empty."""
    first = F.get(F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, NAME, 1)) == name), F.lit(0))
    raw = F.regexp_extract(first, VALUE, 1)
    bare = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0)))).otherwise(raw)
    return F.nullif(F.regexp_replace(_decoded(bare), r"^\s+|\s+$", ""), F.lit(""))


def links_in(pages: DataFrame) -> DataFrame:
    """pages(url, html, ...) without html, a row for each link of a page, with to: where it points, resolved against the page's <base> or else its url; null for other schemes.

    All canonical links and refreshes count, but those within comments, scripts and styles; of several <base> the first with a href, of an attribute that repeats the first."""
    own = [c for c in pages.columns if c != "html"]
    tags = F.filter(F.regexp_extract_all(F.col("html"), F.lit(TAGS), F.lit(0)), lambda t: t.rlike("(?i)^<(?:link|meta|base)"))
    attributes = lambda t: F.regexp_extract_all(t, F.lit(ATTRIBUTES), F.lit(0))
    bases = F.filter(F.transform(F.filter(F.col("_tags"), lambda t: F.lower(F.substring(t, 2, 4)) == "base"), lambda t: _attribute(attributes(t), "href")), lambda h: h.isNotNull())
    # Step by step, each in columns of its own, so that no step's expression is repeated within the next one's.
    t = pages.select(*own, tags.alias("_tags")).where(F.size("_tags") > 0).select(*own, F.get(bases, F.lit(0)).alias("_base"), F.explode("_tags").alias("_tag"))
    t = t.select(*own, "_base", F.lower(F.substring("_tag", 2, 4)).alias("_kind"), attributes(F.col("_tag")).alias("_parts")).where("_kind in ('link', 'meta')")
    t = t.select(*own, "_base", "_kind", *[_attribute(F.col("_parts"), c).alias(f"_{c}") for c in ("rel", "href", "http-equiv", "content")])
    canonical = F.array_contains(F.split(F.lower("_rel"), r"\s+"), "canonical")
    goes = F.concat(*[F.regexp_extract("_content", REFRESH, i) for i in (1, 2, 3)])
    refresh = F.when(F.lower("_http-equiv") == "refresh", F.nullif(F.regexp_replace(goes, r"^\s+|\s+$", ""), F.lit("")))
    t = t.select(*own, "_base", F.when((F.col("_kind") == "link") & canonical, F.col("_href")).when(F.col("_kind") == "meta", refresh).alias("_to")).where("_to is not null")
    t = t.select(*own, F.coalesce(resolved(F.col("_base"), F.col("url")), "url").alias("_from"), "_to")
    return t.select(*own, resolved(F.col("_to"), F.col("_from")).alias("to"))


def _without_dots(path: Column) -> Column:
    """A path that begins with /, without its . and .. segments, as in RFC 3986, 5.2.4."""
    parts = F.slice(F.split(path, "/", -1), 2, F.length(path) + 1)
    kept = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    whole = F.aggregate(parts, F.array().cast("array<string>"), kept)
    return F.concat(F.lit("/"), F.array_join(whole, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(whole) > 0), F.lit("/")).otherwise(F.lit("")))


def resolved(to: Column, url: Column) -> Column:
    """A link resolved against the url of its page or base; links of other schemes than http and https give null."""
    origin = F.concat(F.lit("http://"), host_of(url))
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))
    way, rest = F.regexp_extract(to, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(to, r"(?s)^([^?#]*)(.*)$", 2)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(to.rlike("(?i)^https?://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.rlike("(?i)^[a-z][a-z0-9+.-]*:") | (host_of(url) == ""), F.lit(None).cast("string"))
        .when(to.startswith("/"), F.concat(origin, _without_dots(way), rest))
        .when(to.startswith("?"), F.concat(origin, path, to))
        .when(to.startswith("#"), F.concat(origin, path, query, to))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, way)), rest))
    )


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, ws: Workspace | None = None) -> DataFrame:
    """pages(page_id, url, html, ...), redirects(source_url, target_url) -> page_id, host, path, rule, verdict for each row of pages.

    A null url, or one without ://, has empty host and path, no rule, no aliases, and is allowed. Null html has no links. Equal nodes (and so
    rows that repeat a url) share one place in the graph. Ties between rules: the longest, then the earlier. No rows give no rows."""
    ws = ws or Workspace(pages.sparkSession, "urls")
    page = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"), "url", "html")
    # Written, as conditions on what follows would otherwise be pushed down into copies of the whole scan.
    links = ws.save(links_in(page.select("node", "url", "html")), "links")
    edges = links.select(F.col("node").alias("a"), node_of(F.col("to")).alias("b"))
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("source_url")).alias("a"), node_of(F.col("target_url")).alias("b")))
    component = connected_components(edges.where("a is not null and b is not null"), ws)

    rule, verdict = own_rule(F.col("host"), F.col("path"), rules)
    page = page.select("page_id", "host", "path", "node", rule.alias("rule"), verdict.alias("own"))
    # A node's own verdict depends on its text alone, so nodes that no page has (a redirect's target) are judged as well.
    at = F.concat(F.lit("http://"), F.col("node"))
    judged = component.select("node", "component", own_rule(host_of(at), path_of(at), rules)[1].alias("own"))
    spread = judged.where("own is not null").groupBy("component").agg(F.min("own").alias("spread"))  # allow sorts before block
    by_node = judged.join(spread, "component").select("node", "spread").distinct()
    return page.join(by_node, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))
