"""URL filters (operator 8): rules on host and path, and aliases that share a block.

Pages that redirect to each other or name a canonical address are one resource under several
addresses. Redirects and canonical links are edges, addresses without their fragment are nodes,
and a blocked address blocks its whole component, but for addresses that a rule allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.components import connected_components
from trailmark.llm.workers import stored


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_META_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_META_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        named = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, named).otherwise(found)
    return found


def address(url: Column) -> Column:
    """The node of an address: without fragment, scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    whole = F.concat(ascii_lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))
    return F.when(F.length(head) > 0, whole)


def target_of(url: Column, reference: Column) -> Column:
    """Where ``reference`` on the page at ``url`` points to; null for an empty one."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(reference.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), reference)
        .when(reference.startswith("//"), F.concat(scheme, reference))
        .when(reference.startswith("/"), F.concat(site, reference))
        .when(F.length(reference) > 0, F.concat(folder, reference))
    )


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b) addresses that are one resource: canonical links and meta refreshes in ``html``, and
    the rows of ``redirects`` (from_url, to_url), such as HTTP redirects a crawl has logged."""
    html, url = F.col("html"), F.col("url")
    canonical = F.regexp_extract(F.regexp_extract(html, _LINK_TAG, 0), _HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract(html, _META_TAG, 0), _META_URL, 1)
    references = F.array(F.replace(canonical, F.lit("&amp;"), F.lit("&")), F.replace(refresh, F.lit("&amp;"), F.lit("&")))
    edges = (
        pages.where(F.col("url").isNotNull() & html.rlike(r"(?i)canonical|http-equiv"))
        .select(url, F.explode(references).alias("reference"))
        .select(address(url).alias("a"), address(target_of(url, F.col("reference"))).alias("b"))
    )
    if redirects is not None:
        edges = edges.unionAll(redirects.select(address(F.col("from_url")), address(F.col("to_url"))))
    return edges.where("a <> b").distinct()


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html).

    A rule's verdict stands: an allow rule takes precedence over a block that comes from an alias.
    Without a rule, a page is blocked if an alias of it (any address of its component, page or
    not) is blocked by a rule, else it has the default verdict, allow. A null url, or one without
    ``://``, has empty host and path, no rule and no alias; a null html names no alias. Repeated
    rows give repeated rows; an empty table gives no rows; other columns are not read.
    """
    narrow = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html")
    judged = narrow.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        address(F.col("url")).alias("node"),
    ).withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    columns = ["page_id", "host", "path", F.col("fits.rule").alias("rule")]
    edges = stored(alias_edges(narrow, redirects), "aliases")
    if edges.isEmpty():
        return judged.select(*columns, F.coalesce("fits.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))
    members = stored(connected_components(edges), "alias_groups")
    member_rule = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = members.where(member_rule["verdict"] == "block").select("component").distinct()
    aliases = members.join(blocked, "component", "left_semi").select("node", F.lit("block").alias("alias"))
    return judged.join(aliases, "node", "left").select(
        *columns, F.coalesce("fits.verdict", "alias", F.lit(DEFAULT_VERDICT)).alias("verdict")
    )
