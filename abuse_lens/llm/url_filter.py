"""URL rules whose decisions reach aliases of a page (operator 3).

Pages that redirect to each other or name the same canonical address are one
document.  Redirect and canonical edges are read from the pages, connected
components are computed over the addresses, and a page that no rule fits takes
the decision of its component: allow if any member is allowed by a rule, else
block if any member is blocked, else allow.

Only DataFrame functions are used.  A rule table of any size is met by equality:
an address is looked up under the suffixes of its host and the prefixes of its path
of the lengths that rules have, never by comparing all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.llm.components import connected_components
from abuse_lens.plans.settle import settle

LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What makes two urls the same page: host, path and query; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host(url), rest))


def _absolute(target: Column, base: Column) -> Column:
    """A link as a browser would follow it from ``base``; dot segments are kept as they are."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*((?:/[^?#]*)?/)[^/?#]*", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("#"), base)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(u, v): addresses that are the same page.

    From canonical links and refresh redirects in ``pages(url, html)``, and from
    a ``redirects(source, target)`` table of urls, such as a crawl's, if given.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda tag: F.regexp_extract(tag, HREF, 1))
    metas = F.transform(F.regexp_extract_all(html, F.lit(META), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH, 1))
    small = F.lower(html)
    named = small.contains("canonical") | small.contains("refresh")
    found = (
        pages.where(F.col("url").contains("://") & named)
        .select("url", F.explode(F.concat(links, metas)).alias("target"))
        .where("target <> ''")
    )
    edges = found.select(
        address(F.col("url")).alias("u"), address(_absolute(F.col("target"), F.col("url"))).alias("v")
    )
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("source")), address(F.col("target"))))
    return edges.where("u is not null and v is not null and u <> v")


def _labels(name: Column) -> Column:
    return F.length(name) - F.length(F.translate(name, ".", "")) + 1


def match_rules(addresses: DataFrame, rules: DataFrame, keep: list[str]) -> DataFrame:
    """Each row's longest fitting rule: columns ``keep`` (a key), ``rule`` and ``action``.

    Rows that no rule fits are left out.  Of rules equally long, the longer host
    wins, then allow.
    """
    sizes = rules.agg(
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
        F.sort_array(F.collect_set(_labels(F.col("host")))).alias("labels"),
    ).first()
    lengths = sizes.lengths
    # only the suffixes of as many labels as rules have: a host of many labels has long suffixes
    ends = F.array(*[F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in sizes.labels])
    suffixes = F.array_compact(ends.cast("array<string>"))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    tried = addresses.select(*keep, "path", F.explode(suffixes).alias("rule_host"), "host")
    tried = tried.select(*keep, "rule_host", F.explode(prefixes).alias("rule_path"))
    known = rules.select(
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.concat("host", "path").alias("rule"),
        "action",
    )
    best = F.struct(F.length("rule"), F.length("rule_host"), F.when(F.col("action") == "allow", 1).otherwise(0))
    return (
        tried.join(known, ["rule_host", "rule_path"])
        .groupBy(*keep)
        .agg(F.max_by(F.struct("rule", "action"), best).alias("hit"))
        .select(*keep, "hit.rule", "hit.action")
    )


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and decided_by for every row of ``pages``.

    ``rules`` has host, path and action (allow or block).  A null url, or one
    without ``://``, has an empty host and path and no aliases; a rule with an
    empty host is not for it.  Repeated rows are judged alike, each on its own;
    further columns of ``pages`` are ignored.  An empty table gives no rows, an
    empty rule table allows everything.
    """
    named = pages.select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        address(F.col("url")).alias("address"),
    )
    rules = rules.where("host <> ''")
    edges = settle(alias_edges(pages, redirects))
    members = connected_components(edges).withColumnRenamed("node", "address")

    # the rules' decisions over whole components, also those of addresses that are no page
    at = F.concat(F.lit("a://"), F.col("address"))
    ruled = match_rules(members.select("address", host(at).alias("host"), path(at).alias("path")), rules, ["address"])
    group = (
        members.join(ruled, "address")
        .groupBy("component")
        .agg(F.when(F.max(F.col("action") == "allow"), "allow").otherwise("block").alias("group_verdict"))
    )
    aliases = members.join(group, "component").select("address", "group_verdict")

    hits = match_rules(named.select("host", "path").distinct(), rules, ["host", "path"])
    return (
        named.join(hits, ["host", "path"], "left")
        .join(aliases, "address", "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("action", "group_verdict", F.lit("allow")).alias("verdict"),
            F.when(F.col("rule").isNotNull(), "rule").when(F.col("group_verdict").isNotNull(), "alias")
            .otherwise("default").alias("decided_by"),
        )
    )
