"""Where the description behind an application link is served, and how to read the answer.

Nothing here opens a connection: ``requests`` names the addresses to land, and
``description`` reads what was landed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysieve.functions.text import let, or_null, text
from tallysieve.functions.urls import apply_platform
from tallysieve.sources.boards import unescaped
from tallysieve.sources.html import parse
from tallysieve.sources.pages import MAX_DESCRIPTION, MIN_CONTENT, html_text, page_text

#: Platforms that have an answer of their own; all others are read as web pages.
ROUTED = ("greenhouse", "lever", "ashby", "workday", "icims")
_UUID = r"[0-9a-fA-F-]{36}"


def route(url: Column) -> Column:
    """The reader for a link: one of ``ROUTED``, or generic; null for no link."""
    return F.when(text(url) != "", let(apply_platform(url), lambda p: F.when(p.isin(*ROUTED), p).otherwise("generic")))


def requests(url: Column) -> Column:
    """The addresses to land for a link, best first; empty where the link names no posting."""
    one = lambda p, k: F.regexp_extract(url, p, k)
    board, job = one(r"greenhouse\.io/([^/]+)/jobs/(\d+)", 1), one(r"greenhouse\.io/([^/]+)/jobs/(\d+)", 2)
    firm, posting = one(rf"lever\.co/([^/]+)/({_UUID})", 1), one(rf"lever\.co/([^/]+)/({_UUID})", 2)
    org = one(rf"ashbyhq\.com/([^/]+)/{_UUID}", 1)
    host, site, path = (one(r"^[A-Za-z]+://([^/?#]+)/+(.*?)/job/([^?#]*?)/*(?:[?#]|$)", k) for k in (1, 2, 3))
    tenant = F.substring_index(F.lower(host), ".", 1)
    bare = or_null(F.regexp_extract(site, "^[a-zA-Z]{2}(?:-[a-zA-Z]{2})?/(.+)$", 1))
    workday = lambda s: F.concat(F.lit("https://"), F.lower(host), F.lit("/wday/cxs/"), tenant, F.lit("/"), s, F.lit("/job/"), path)
    found = (
        F.when(route(url) == "greenhouse", F.array(F.when(board != "", F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), board, F.lit("/jobs/"), job))))
        .when(route(url) == "lever", F.array(F.when(firm != "", F.concat(F.lit("https://api.lever.co/v0/postings/"), firm, F.lit("/"), posting))))
        .when(route(url) == "ashby", F.array(F.when(org != "", F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), org))))
        .when(route(url) == "workday", F.when(site != "", F.array(workday(site), F.when(bare.isNotNull(), workday(bare)))))
        .when(route(url) == "icims", F.array(F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("in_iframe=1"))))
        .when(route(url) == "generic", F.array(url))
    )
    return F.array_compact(F.coalesce(found, F.array().cast("array<string>")))


def _framed(html: str) -> str | None:
    """The posting inside an iCIMS frame, if it is long enough to be one."""
    node = parse(html).first("div", "iCIMS_JobContent")
    found = node.text(" ") if node else ""
    return found[:MAX_DESCRIPTION] if len(found) > MIN_CONTENT else None


def description(url: Column, payload: Column) -> Column:
    """The description in a landed answer; null if there is none."""
    cut = lambda c: or_null(F.left(c, F.lit(MAX_DESCRIPTION)))
    json = lambda path: F.get_json_object(payload, path)
    wanted = F.regexp_extract(url, rf"ashbyhq\.com/[^/]+/({_UUID})", 1)
    jobs = F.from_json(payload, "jobs array<struct<id:string,descriptionPlain:string>>")["jobs"]
    own = F.get(F.filter(jobs, lambda j: j["id"] == wanted), F.lit(0))["descriptionPlain"]
    markup = F.when(route(url) == "greenhouse", unescaped(json("$.content"))).when(route(url) == "workday", json("$.jobPostingInfo.jobDescription"))
    framed = F.pandas_udf(lambda h: h.map(_framed, na_action="ignore"), "string")
    whole: Column = (
        F.when(route(url).isin("greenhouse", "workday"), or_null(html_text(markup)))
        .when(route(url) == "lever", cut(json("$.descriptionPlain")))
        .when(route(url) == "ashby", cut(own))
        .when(route(url) == "icims", framed(F.when(route(url) == "icims", payload)))
    )
    return whole.when(route(url) == "generic", page_text(F.when(route(url) == "generic", payload)))
