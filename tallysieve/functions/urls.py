"""Identity of application targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysieve.functions.text import let, or_null, plain_words, stripped, text

#: Query keys that don't change the target.
TRACKING = (
    "ats", "fr", "gh_src", "lever-origin", "lever-source", "nl", "ref", "source", "src", "trackingid", "trk",
    "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term",
)


@dataclass(frozen=True)
class Url:
    """Parts of a url; all null if it has no scheme or host, or its path a bad escape."""

    host: Column
    path: Column
    query: Column


def split_url(raw: Column) -> Url:
    t = F.trim(raw)
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?"
    group = lambda k: F.regexp_extract(t, pattern, k)
    # The decoder reads + as a blank, which paths don't mean.
    path = F.try_url_decode(F.replace(group(3), F.lit("+"), F.lit("%2B")))
    good = (F.length(group(2)) > 0) & path.isNotNull()
    return Url(F.when(good, F.lower(group(2))), F.when(good, path), F.when(good, group(4)))


def application_href(url: Column, apply_url: Column, easy: Column) -> Column:
    """The posting's own page if one applies there, else the target; only null falls back."""
    return F.when(F.coalesce(easy, F.lit(False)), url).otherwise(F.coalesce(apply_url, url))


def display_href(url: Column, apply_url: Column) -> Column:
    """A link to show: empty falls back too."""
    return F.coalesce(or_null(apply_url), or_null(url), F.lit("#"))


def canonical_target(row_id: Column, href: Column) -> Column:
    """One key for all urls of the same application: requisition of a known platform, else the cleaned url."""
    u = split_url(href)
    path = let(F.regexp_replace(u.path, "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
    facts = F.struct(F.regexp_replace(u.host, r"^www\.", "").alias("host"), path.alias("path"), u.query.alias("query"))
    return let(facts, lambda x: _target_key(row_id, x["host"], x["path"], x["query"]))


def _target_key(row_id: Column, host: Column, path: Column, query: Column) -> Column:
    one = lambda p, k=1: or_null(F.regexp_extract(path, p, k))
    tenant = F.regexp_replace(F.substring_index(host, ".", 1), "[^a-z0-9]", "")
    req = F.regexp_replace(F.regexp_replace(F.lower(one(r"(?i)_((?:JR|R)[-_]?[A-Z0-9-]+)$")), "^jr-", "jr"), "^r-", "r")
    req = F.regexp_replace(req, r"^((?:jr|r)\d{4,})-\d+$", "$1")
    uuid = "[0-9a-f]{8}-[0-9a-f-]{27,}"
    board = one(r"(?i)/([^/]+)/jobs/(\d+)")
    board_query = or_null(F.regexp_extract(query, r"(?:^|&)gh_jid=([^&]+)", 1))
    rules = (
        (host.endswith("linkedin.com"), F.concat(F.lit("linkedin:"), one(r"(?i)/jobs/view/(?:.*?-)?(\d{7,})(?:/|$)"))),
        (host.endswith(".myworkdayjobs.com"), F.concat(F.lit("workday:"), tenant, F.lit(":"), req)),
        (host.contains("greenhouse.io"), F.coalesce(F.concat(F.lit("greenhouse:"), F.lower(board), F.lit(":"), one(r"(?i)/([^/]+)/jobs/(\d+)", 2)), F.concat(F.lit("greenhouse:"), host, F.lit(":"), board_query))),
        (host.endswith("lever.co"), F.concat(F.lit("lever:"), F.lower(one(rf"(?i)/({uuid})(?:/apply)?$")))),
        (host.endswith("ashbyhq.com"), F.concat(F.lit("ashby:"), F.lower(one(rf"(?i)^/([^/]+)/({uuid})$")), F.lit(":"), F.lower(one(rf"(?i)^/([^/]+)/({uuid})$", 2)))),
        (host.contains("jobvite.com"), F.concat(F.lit("jobvite:"), F.lower(one(r"(?i)/job/([a-z0-9_-]+)")))),
        (host.endswith("smartrecruiters.com"), F.concat(F.lit("smartrecruiters:"), one(r"/([0-9]{10,})(?:/|$)"))),
        (host.contains("icims.com"), F.concat(F.lit("icims:"), F.substring_index(host, ".", 1), F.lit(":"), one(r"(?i)/jobs/(\d+)(?:/|$)"))),
    )
    known = F.coalesce(*(F.when(at, key) for at, key in rules))
    keys = F.filter(F.split(text(query), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    # A parameter without a value is written with an empty one.
    pairs = F.array_sort(F.transform(keys, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    cleaned = F.concat(F.lit("url:"), host, F.lower(path), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))
    return F.coalesce(known, cleaned, F.concat(F.lit("row:"), row_id))


def is_search_site(href: Column) -> Column:
    """Whether the target is the search site's own page."""
    return F.coalesce(split_url(href).host.endswith("linkedin.com"), F.lit(False))


def target_words(href: Column) -> Column:
    """Comparable words of a target's host and path."""
    u = split_url(href)
    return plain_words(F.concat_ws(" ", u.host, u.path))


def tracker_url(c: Column) -> Column:
    """Host without www and path without end slashes or query; empty for no url."""
    t = stripped(text(c))
    full = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))
    pattern = r"(?s)^[^:/?#]*://([^/?#]*)([^?#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(full, pattern, 1)), r"^www\.", "")
    # Path parameters after a semicolon in the last segment are not part of the path.
    path = F.regexp_replace(F.regexp_extract(full, pattern, 2), r";[^/]*$", "")
    return F.when(t == "", "").otherwise(F.concat(host, F.regexp_replace(path, "/+$", "")))


def apply_platform(url: Column) -> Column:
    """The platform that serves an application form, by host; null if unknown."""
    return let(split_url(url).host, _platform_of)


def _platform_of(host: Column) -> Column:
    at = lambda d: (host == d) | host.endswith("." + d)
    return (
        F.when(host.contains("greenhouse.io"), "greenhouse")
        .when(host.contains("lever.co"), "lever")
        .when(host.contains("ashbyhq.com"), "ashby")
        .when(host.contains("myworkdayjobs.com"), "workday")
        .when(host.contains("icims.com"), "icims")
        .when(host.contains("careers.ibm.com"), "ibm")
        .when(at("avature.net"), "avature")
    )
