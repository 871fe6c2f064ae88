"""Places in location texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysieve.functions.text import plain, stripped, text

_SEAM = "\u0000"
#: Name parts that a following capital belongs to.
NAME_PREFIX = r"(?i)^(Mc|Mac|De|Di|Du|La|Le|Van|Von|St\.?|Ste\.?|O'|D')$"
COUNT_ONLY = r"(?i)^\d+\s+locations?$"


def is_count_only(c: Column) -> Column:
    return stripped(text(c)).rlike(COUNT_ONLY)


def split_locations(c: Column) -> Column:
    """The single places of a text that strings them together, with or without separators."""
    t = stripped(text(c))
    run = F.regexp_replace(t, r"(?i)^\d+\s+locations?", "")
    run = F.regexp_replace(run, "([A-Z]{2})([A-Z][a-z])", f"$1{_SEAM}$2")
    run = F.regexp_replace(run, "([a-z)])([A-Z][a-z])", f"$1{_SEAM}$2")
    parts = F.filter(F.transform(F.split(run, rf"{_SEAM}|\s*;\s*"), stripped), lambda p: p != "")
    none = F.array().cast("array<string>")
    joined = F.aggregate(
        parts,
        none,
        lambda acc, p: F.when(
            (F.size(acc) > 0) & F.element_at(acc, -1).rlike(NAME_PREFIX),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), p))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(t.rlike(COUNT_ONLY), F.array(t)).otherwise(joined)


def normalized_locations(c: Column) -> Column:
    """Comparable places: 'city, ST' pairs and the parts of a list, big cities under one name."""
    pairs = F.transform(F.regexp_extract_all(text(c), F.lit(r"([A-Za-z][A-Za-z .'-]*?,\s*[A-Z]{2})\b"), 1), _place)
    parts = F.transform(F.split(text(c), r"\s*[·;]\s*"), lambda p: _place(F.regexp_replace(p, r"\+\d+\s*$", "")))
    return F.array_distinct(F.filter(F.concat(pairs, parts), lambda p: p != ""))


def _place(c: Column) -> Column:
    p = plain(c)
    return F.when(p.isin("new york city ny", "nyc"), "new york ny").when(p == "la", "los angeles ca").otherwise(p)
