"""Features of titles and companies that decide whether two postings are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysieve.functions.text import plain_words, text

#: Words that don't tell companies apart, for matching.
COMPANY_NOISE = (
    "a", "an", "the", "and", "inc", "incorporated", "llc", "corp", "corporation", "co", "company", "international",
    "electronics", "financial", "technologies", "technology", "labs", "group", "holdings", "solutions", "software", "ltd",
    "limited", "plc", "industries", "services", "systems", "digital", "global", "ventures", "private", "pvt", "careers",
)
TITLE_NOISE = (
    "a", "an", "and", "at", "for", "in", "of", "on", "opportunities", "opportunity", "program", "students", "student",
    "the", "to", "university", "us", "usa",
)
SEASONS = ("spring", "summer", "fall", "autumn", "winter")
STATES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|"
    "RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
)
SPECIALIZATIONS = (
    ("ai", r"\b(ai|artificial intelligence)\b"),
    ("analytics", r"\b(analytics?|analyst)\b"),
    ("application", r"\bapplication\b"),
    ("backend", r"\b(back[ -]?end|backend)\b"),
    ("business", r"\bbusiness\b"),
    ("cloud", r"\bcloud\b"),
    ("data", r"\bdata\b"),
    ("devops", r"\bdevops\b"),
    ("digital", r"\bdigital\b"),
    ("embedded", r"\bembedded\b"),
    ("enterprise-systems", r"\benterprise systems?\b"),
    ("firmware", r"\bfirmware\b"),
    ("forward-deployed", r"\b(forward deployed|fdse)\b"),
    ("frontend", r"\b(front[ -]?end|frontend)\b"),
    ("fullstack", r"\b(full[ -]?stack|fullstack)\b"),
    ("hardware", r"\bhardware\b"),
    ("infrastructure", r"\b(infrastructure|infra)\b"),
    ("machine-learning", r"\b(machine learning|ml)\b"),
    ("mobile", r"\bmobile\b"),
    ("mlops", r"\bmlops\b"),
    ("operations", r"\boperations?\b"),
    ("platform", r"\bplatform\b"),
    ("product", r"\bproduct\b"),
    ("qa-test", r"\b(automation|quality assurance|qa|test)\b"),
    ("research", r"\bresearch\b"),
    ("security", r"\b(cyber|security)\b"),
    ("site-reliability", r"\b(site reliability|sre)\b"),
    ("software", r"\bsoftware\b"),
    ("strategy", r"\bstrategy\b"),
)
#: Labels that tell parallel postings apart even if both also say something general.
STRONG = (
    "backend", "data", "embedded", "enterprise-systems", "firmware", "forward-deployed", "frontend", "fullstack",
    "infrastructure", "machine-learning", "mobile", "mlops", "platform", "product", "qa-test", "security", "site-reliability",
)


def company_words(c: Column) -> Column:
    """Distinct telling words of a company's name, in order; all of them if none is telling."""
    every = plain_words(F.regexp_replace(F.regexp_replace(text(c), r"(?i)\(yc.*?\)", ""), r"(?i)'s\b", ""))
    telling = F.filter(every, lambda w: ~w.isin(*COMPANY_NOISE))
    return F.array_distinct(F.when(F.size(telling) > 0, telling).otherwise(every))


def company_buckets(words: Column) -> Column:
    """Blocking keys: the whole name and each word of three letters or more."""
    long = F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit("word:"), w))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("full:"), F.array_join(words, " "))), long))


def seasons(title: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text(title)), F.lit(r"\b(" + "|".join(SEASONS) + r")\b"), 1)
    return F.array_distinct(F.transform(found, lambda s: F.when(s == "autumn", "fall").otherwise(s)))


def years(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(title), F.lit(r"\b(20\d\d)\b"), 1))


def states(title: Column) -> Column:
    """State codes of the title in capitals, so the words in, or and me count."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text(title)), F.lit(rf"\b({STATES})\b"), 1))


def disagree(a: Column, b: Column) -> Column:
    """Both name something and nothing is shared."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def specializations(title: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text(title).rlike(f"(?i){p}"), name) for name, p in SPECIALIZATIONS)))


def strong(labels: Column) -> Column:
    return F.filter(labels, lambda x: x.isin(*STRONG))


def title_words(title: Column, company: Column, location: Column) -> Column:
    """Distinct telling words of a title, without those of its company and place."""
    own = F.filter(plain_words(title), lambda w: ~w.isin(*TITLE_NOISE, *SEASONS) & ~w.rlike(r"^20\d\d$"))
    rest = F.filter(own, lambda w: ~F.array_contains(company_words(company), w) & ~F.array_contains(plain_words(location), w))
    return F.array_distinct(F.transform(rest, lambda w: F.when(w == "engineering", "engineer").otherwise(w)))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other has; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.least(F.size(a), F.size(b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
