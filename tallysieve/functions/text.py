"""Names and texts in comparable form."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't tell companies apart, for storage keys.
COMPANY_NOISE = (
    "inc", "llc", "corp", "co", "company", "international", "electronics", "financial", "technologies", "technology",
    "labs", "group", "holdings", "solutions", "software", "ltd", "plc", "industries", "services", "systems", "digital",
    "global", "ventures",
)
#: Block markup ends a sentence, inline markup and blanks become one space.
BLOCK_MARKUP = r"(?i)&#xa;|&#xd;|[\r\n]|<\s*/?\s*(?:p|div|li|ul|ol|br|tr|td|th|h[1-6]|section|table)\b[^>]{0,200}>"
INLINE_MARKUP = r"(?i)&#x9;|&nbsp;|&#160;|<[^>]{1,200}>|\s+"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_null(c: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(c, F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def norm_company(company: Column) -> Column:
    """Company name as a key: lower case, no batch tag, possessive, article or noise words."""
    c = F.lower(stripped(text(company)))
    c = F.regexp_replace(F.regexp_replace(c, r"\(yc.*?\)", ""), r"'s\b", "")
    all_words = words(F.regexp_replace(c, "[^a-z0-9 ]", " "))
    all_words = F.when(F.get(all_words, F.lit(0)) == "the", F.slice(all_words, F.lit(2), F.greatest(F.size(all_words), F.lit(1)))).otherwise(all_words)
    telling = F.filter(all_words, lambda w: ~w.isin(*COMPANY_NOISE))
    return F.array_join(F.when(F.size(telling) > 0, telling).otherwise(all_words), " ")


def norm_role(title: Column) -> Column:
    """Title as a key: lower-case words without internship markers; seasons stay."""
    t = F.regexp_replace(F.lower(stripped(text(title))), "[^a-z0-9 ]", " ")
    t = F.regexp_replace(t, r"\b(internship|intern|co\s*op|coop)\b", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def norm_key(company: Column, title: Column) -> Column:
    return F.concat(norm_company(company), F.lit("|"), norm_role(title))


def norm_school(name: Column) -> Column:
    """School name without its generic words and punctuation."""
    core = F.regexp_replace(F.regexp_replace(text(name), r"(?i)\b(?:university|college)\b", ""), r"\bof\b", "")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(core, r"(?U)[^\w\s]", " ")), r"(?U)\s+", " "))


def flat_markup(c: Column) -> Column:
    """Markup and runs of blanks as sentence ends and single spaces; a text with neither is looked at once."""
    flat = lambda t: F.regexp_replace(F.regexp_replace(t, BLOCK_MARKUP, " . "), INLINE_MARKUP, " ")
    return let(text(c), lambda t: F.trim(F.when(F.rlike(t, F.lit(r"[&<\t\n\x0B\f\r]|  ")), flat(t)).otherwise(t)))


def _decomposed(c: Column) -> Column:
    """Compatibility decomposition without combining marks; Spark has no built-in for it."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not "\u0300" <= x <= "\u036f"), na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def plain(c: Column, compatibility: bool = False) -> Column:
    """Lower-case ASCII words.  Letters beyond Latin-1 need ``compatibility``, which runs in Python workers."""
    folded = _decomposed(text(c)) if compatibility else F.translate(text(c), _ACCENTED, _BARE)
    return F.trim(F.regexp_replace(F.replace(F.lower(folded), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def _latin() -> tuple[str, str]:
    """Letters below U+0180 that are one ASCII letter and marks, and those ASCII letters."""
    pairs = []
    for code in range(0xC0, 0x180):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not "\u0300" <= c <= "\u036f")
        if len(bare) == 1 and bare.isascii():
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BARE = _latin()


def singular(word: Column) -> Column:
    long = F.length(word) > 4
    return (
        F.when(long & word.endswith("ies"), F.concat(word.substr(F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(long & word.endswith("s") & ~word.endswith("ss"), word.substr(F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def plain_words(c: Column) -> Column:
    return F.transform(words(plain(c)), singular)
