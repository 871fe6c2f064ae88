"""Readable text of web pages, and listings of search pages."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.salary import chip_salary, range_salary
from tallysieve.sources.html import Node, parse

MAX_DESCRIPTION, MAX_CRITERIA, MIN_CONTENT = 12_000, 6_000, 200
#: Ids and classes of page furniture, and where a posting's own content stands, best first.
FURNITURE = re.compile(
    r"cookie|consent|gdpr|privacy|nav|menu|dropdown|breadcrumb|footer|search-?(?:bar|box|form|widget)|job-?alert|alert-?(?:box|signup)"
    r"|social|share|skip-?link|banner|masthead|sidebar|toolbar",
    re.I,
)
CONTENT = (
    ("data-automation-id", "jobPostingDescription"), ("class", "job-description"), ("class", "jobDescription"), ("id", "job-description"),
    ("id", "jobDescription"), ("class", "job-details"), ("class", "jobDetail"), ("class", "posting-description"), ("", "article"),
    ("role", "main"), ("", "main"),
)


def strip_furniture(root: Node) -> None:
    """Drop site furniture by tag, then by id and class."""
    for node in root.all("script", "style", "nav", "header", "footer"):
        node.drop()
    for node in root.all("div", "section", "aside", "ul", "form", "span"):
        if FURNITURE.search(f"{node.attrs.get('id', '')} {node.attrs.get('class', '')}".strip()):
            node.drop()


def _is_content(node: Node, attr: str, mark: str) -> bool:
    if not attr:
        return node.tag == mark
    value = node.attrs.get(attr, "")
    return value == mark if attr == "role" else mark in value


def content_text(html: str | None) -> str | None:
    """The page's own content without furniture; null if there are at most ``MIN_CONTENT`` characters."""
    if not html:
        return None
    root = parse(html)
    strip_furniture(root)
    for attr, mark in CONTENT:
        for node in root.walk():
            if _is_content(node, attr, mark) and len(found := node.text(" ")) > MIN_CONTENT:
                return found[:MAX_DESCRIPTION]
    whole = root.text(" ")
    return whole[:MAX_DESCRIPTION] if len(whole) > MIN_CONTENT else None


def page_text(html: Column) -> Column:
    return F.pandas_udf(lambda h: h.map(content_text, na_action="ignore"), "string")(html)


def html_text(html: Column) -> Column:
    """All text of a piece of markup, cut to the longest description kept."""
    return F.pandas_udf(lambda h: h.map(lambda x: parse(x).text(" ")[:MAX_DESCRIPTION], na_action="ignore"), "string")(html)


_CARD = "array<struct<id:string,title:string,company:string,location:string,url:string,posted_at:string,is_easy_apply:boolean>>"


def cards(html: str | None, host: str = "https://www.linkedin.com") -> list[dict]:
    """Listings of a search page; a card without an id or title is no listing."""
    out = []
    for card in parse(html or "").all("li"):
        holder = next((n for n in card.walk() if "data-entity-urn" in n.attrs), None)
        found = re.search(r"jobPosting:(\d+)", holder.attrs["data-entity-urn"]) if holder else None
        text = lambda tag, cls, card=card: n.text() if (n := card.first(tag, cls)) else ""
        title = text("h3", "base-search-card__title")
        if not found or not title:
            continue
        time, link = card.first("time"), card.first("a", "base-card__full-link")
        url = link.attrs.get("href", "").split("?")[0] if link else f"{host}/jobs/view/{found[1]}/"
        out.append({
            "id": found[1], "title": title, "company": text("h4", "base-search-card__subtitle"), "location": text("span", "job-search-card__location"),
            "url": url, "posted_at": time.attrs.get("datetime") if time else None, "is_easy_apply": "easy apply" in card.text(" ").lower(),
        })
    return out


def card_listings(pages: DataFrame) -> DataFrame:
    """Listings of search pages (search_term, html)."""
    read = F.pandas_udf(lambda h: h.map(cards), _CARD)
    rows = pages.select("search_term", F.explode(read("html")).alias("c")).select("search_term", "c.*")
    return rows.select("id", "title", "company", "location", "url", F.lit(None).cast("string").alias("apply_url"), "posted_at", F.lit(None).cast("string").alias("description"), "is_easy_apply", "search_term")


_DETAIL = "struct<description:string,logo_url:string,external:string,easy:boolean,low:string,high:string,unit:string,chip:string>"


def detail(html: str | None) -> dict:
    """Description, logo and structured facts of a posting's page."""
    root = parse(html or "")
    out: dict = dict.fromkeys(("description", "logo_url", "external", "low", "high", "unit", "chip"))
    out["easy"] = False
    if (node := root.first("div", "show-more-less-html__markup")) is not None:
        out["description"] = node.text(" ")[:MAX_DESCRIPTION]
    elif (node := root.first("ul", "description__job-criteria-list")) is not None:
        out["description"] = node.text(" ")[:MAX_CRITERIA]
    sources = (n.attrs.get("data-delayed-url") or n.attrs.get("src", "") for n in root.all("img"))
    out["logo_url"] = next((s for s in sources if "media.licdn.com" in s and "company-logo" in s), None)
    for script in root.all("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            facts = json.loads(script.raw())
        except ValueError:
            continue
        if isinstance(facts, dict) and facts.get("@type") == "JobPosting":
            out["easy"] = bool(facts.get("directApply"))
            link = facts.get("url") or ""
            out["external"] = link if link and "linkedin.com" not in link and not out["easy"] else None
            pay = facts.get("baseSalary")
            pay = pay.get("value") if isinstance(pay, dict) else None
            if isinstance(pay, dict):
                out["low"], out["high"], out["unit"] = (None if pay.get(k) in (None, "") else str(pay[k]) for k in ("minValue", "maxValue", "unitText"))
            break
    for cls in ("compensation__salary", "salary"):
        node = next((n for n in root.walk() if cls in n.classes()), None)
        if node is not None and "$" in (chip := " ".join(node.text(" ").split())):
            out["chip"] = chip
            break
    out["easy"] = out["easy"] or "easy apply" in (html or "").lower()
    return out


def details(pages: DataFrame) -> DataFrame:
    """(id, description, logo_url, apply_url, is_easy_apply, salary) of posting pages (id, html)."""
    read = F.pandas_udf(lambda h: pd.DataFrame([detail(x) for x in h], columns=["description", "logo_url", "external", "easy", "low", "high", "unit", "chip"]), _DETAIL)
    d = pages.select("id", read("html").alias("d")).select("id", "d.*")
    pay = F.coalesce(range_salary(F.col("low"), F.col("high"), F.col("unit")), chip_salary(F.col("chip")))
    return d.select("id", "description", "logo_url", F.col("external").alias("apply_url"), F.col("easy").alias("is_easy_apply"), pay.alias("salary"))
