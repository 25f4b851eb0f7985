"""URL filter with redirect equivalence, by DataFrame functions only.

Rules of host and path judge a url; the longest rule that fits wins.  Pages
that redirect, or name a canonical address, are aliases: connected components
over these links carry block decisions to every alias that no rule of its own
judges.  An explicit rule of a page's own, allow included, takes precedence
over what its component says; a component without a blocked member is allowed.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


#: The rules of the standard query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def judged(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


_TAG = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>;]*;\s*url\s*=\s*[\"']?([^\"'\s>]+)"
_SITE = r"(?s)^(.*?://[^/?#]*)(.*)$"


def _address(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case."""
    plain = F.regexp_replace(url, r"(?s)#.*", "")
    return F.when(plain.contains("://"), F.concat(ascii_lower(F.regexp_extract(plain, _SITE, 1)), F.regexp_extract(plain, _SITE, 2))).otherwise(plain)


def _without_dots(path: Column) -> Column:
    """A path, with what follows it, without its ``.`` and ``..`` segments."""
    plain, rest = F.regexp_extract(path, r"(?s)^([^?]*)", 1), F.regexp_extract(path, r"(?s)^[^?]*(.*)$", 1)
    parts = F.split(plain, "/")
    none = F.array().cast("array<string>")
    # a last segment that is a dot segment leaves its slash
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    # the empty segment before the first slash stays
    kept = F.aggregate(parts, none, lambda got, s: F.when(s == ".", got).when(s == "..", F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(1)))).otherwise(F.concat(got, F.array(s))))
    return F.when(plain.rlike(r"(?s)/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), rest)).otherwise(path)


def _resolved(target: Column, url: Column) -> Column:
    """The address that a page at ``url`` means by ``target``; null if it is none."""
    t = F.regexp_replace(F.regexp_replace(target, "(?i)&(amp|#38|#x26);", "&"), r"(?s)#.*", "")
    page = F.regexp_replace(url, r"(?s)#.*", "")
    scheme, site, path = F.regexp_extract(page, r"(?s)^(.*?)://", 1), F.regexp_extract(page, _SITE, 1), path_of(page)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise("/")
    full = (
        F.when(t.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(~page.contains("://") | (t == "") | t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(site, _without_dots(t)))
        .when(t.startswith("?"), F.concat(site, path, t))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, t))))
    )
    return _address(full)


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(a, b)``: a page's address and each that it redirects to or calls canonical.

    Targets may be absolute or relative, dot segments included, and may hold
    ``&amp;``; scheme and host count in any case.  Targets of other kinds
    (``mailto:``), and pages without a url, give no link.
    """
    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    # a plain substring test spares most pages the regular expressions
    hint = F.lower(h)
    c = F.when(hint.contains("canonical"), F.regexp_extract_all(h, F.lit(_TAG), F.lit(1)))
    r = F.when(hint.contains("refresh"), F.regexp_extract_all(h, F.lit(_REFRESH), F.lit(1)))
    none = F.array().cast("array<string>")
    p = pages.select(u.alias("u"), F.concat(F.coalesce(c, none), F.coalesce(r, none)).alias("targets")).where("u is not null and size(targets) > 0")
    p = p.select("u", F.explode(F.array_distinct("targets")).alias("t"))
    return p.select(_address(F.col("u")).alias("a"), _resolved(F.col("t"), F.col("u")).alias("b")).where("b is not null and a <> b")


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple[Rule, ...] = RULES, links: DataFrame | None = None) -> DataFrame:
    """``(key, host, path, rule, verdict)`` for every page.

    ``links`` (columns a, b) adds known redirects to those read from the pages.
    A null url, or one without ``://``, has an empty host and path, fits no
    rule and has no aliases: allow.  Repeated rows are kept, equal urls are one
    address, an empty table gives an empty result, other columns are ignored.
    """
    edges = alias_links(pages, url, html)
    if links is not None:
        edges = edges.unionByName(links.select(_address(F.col("a")).alias("a"), _address(F.col("b")).alias("b")))
    parts = connected_components(edges)
    u = F.col(f"`{url}`")
    own = pages.select(F.col(f"`{key}`").alias(key), _address(u).alias("address"), host_of(u).alias("host"), path_of(u).alias("path"))
    own = own.withColumn("own", judged(F.col("host"), F.col("path"), rules))
    seen = parts.withColumn("own", judged(host_of(F.col("node")), path_of(F.col("node")), rules))
    blocked = seen.where(F.col("own.verdict") == "block").select("component").distinct()
    tainted = parts.join(blocked, "component", "left_semi").select("node").distinct()
    out = own.join(tainted, F.col("address") == F.col("node"), "left")
    verdict = F.coalesce("own.verdict", F.when(F.col("node").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select(key, "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
