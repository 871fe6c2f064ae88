"""Pay figures in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysieve.functions.text import or_null, stripped, text

_AMOUNT = r"\$\s*[\d,]+(?:\.\d+)?"
_TO = r"(?:[-–—]+|\s*to\s*)"
#: Patterns in order of trust; the last two count only away from the words below.
ANCHORED = (
    rf"{_AMOUNT}\s*/\s*h(?:ou)?r\s*{_TO}\s*{_AMOUNT}\s*/\s*h(?:ou)?r",
    rf"{_AMOUNT}\s*{_TO}\s*{_AMOUNT}\s*/\s*h(?:ou)?r",
    rf"{_AMOUNT}\s*{_TO}\s*{_AMOUNT}\s*per\s*hour",
    rf"{_AMOUNT}\s*{_TO}\s*{_AMOUNT}\s*(?:/\s*yr|per\s*year|annually)",
    rf"\$\s*[\d,]{{5,}}\s*{_TO}\s*\$\s*[\d,]{{5,}}",
    rf"\$\d+[kK]\s*{_TO}\s*\$\d+[kK]",
    rf"{_AMOUNT}\s*/\s*h(?:ou)?r",
    rf"{_AMOUNT}\s*per\s*hour",
)
UNANCHORED = (r"\$\d+[kK]", r"\$\s*[\d,]{5,}")
OTHER_MONEY = r"(?i)(tuition|reimburs|bonus|sign[- ]?on|relocation|stipend)"
LOOK_BACK = 40


def extract_salary(c: Column) -> Column:
    """The first pay figure by order of pattern; null if none."""
    found = [or_null(F.regexp_extract(text(c), f"(?i){p}", 0)) for p in ANCHORED]
    for p in UNANCHORED:
        hit = or_null(F.regexp_extract(text(c), f"(?i){p}", 0))
        before = F.right(F.regexp_extract(text(c), f"(?is)^(.*?){p}", 1), F.lit(LOOK_BACK))
        found.append(F.when(~before.rlike(OTHER_MONEY), hit))
    return F.when(text(c).contains("$"), stripped(F.coalesce(*found)))


def compact_salary(c: Column) -> Column:
    """A pay text for a narrow column: rounded, thousands as k, one unit."""
    raw = text(c)
    unit = F.lower(F.regexp_extract(raw, r"(?i)/?\s*(hr|hour|wk|week|mo|month|yr|year)", 1))
    suffix = F.when(unit.startswith("h"), "/hr").when(unit.startswith("w"), "/wk").when(unit.startswith("mo"), "/mo").when(unit.startswith("y"), "/yr").otherwise("")
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(r"\$\s*([\d,]+(?:\.\d+)?)"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    low, high = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    whole = lambda x: F.floor(x + 0.5).cast("string")
    short = lambda x: F.when(x >= 1000, F.concat(whole(x / 1000), F.lit("k"))).otherwise(whole(x))
    left = F.when((low >= 1000) & (high >= 1000), whole(low / 1000)).otherwise(short(low))
    return (
        F.when(F.size(numbers) == 0, F.when(F.length(raw) > 12, F.concat(F.left(raw, F.lit(11)), F.lit("…"))).otherwise(raw))
        .when(high.isNotNull() & (high != low), F.concat(F.lit("$"), left, F.lit("–"), short(high), suffix))
        .otherwise(F.concat(F.lit("$"), short(low), suffix))
    )


#: Pay as shown on search pages.
_CHIP = r"\$\s*([\d,]+)(?:\.00)?\s*/?\s*(hr|hour|wk|week|mo|month|yr|year)?"


def chip_salary(c: Column) -> Column:
    """Pay chip text: a range with one unit, equal ends collapsed; else its first 60 characters; null without a dollar."""
    t = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    pair = rf"(?i){_CHIP}\s*[-–—]\s*{_CHIP}"
    part = lambda p, k: or_null(F.regexp_extract(t, p, k))
    with_unit = lambda amount, unit: F.concat(amount, F.coalesce(F.concat(F.lit("/"), F.lower(unit)), F.lit("")))
    low, high = part(pair, 1), part(pair, 3)
    ends = F.when(low == high, F.concat(F.lit("$"), low)).otherwise(F.concat(F.lit("$"), low, F.lit("–$"), high))
    one = part(f"(?i){_CHIP}", 1)
    return (
        F.when(~t.contains("$"), None)
        .when(low.isNotNull(), with_unit(ends, F.coalesce(part(pair, 2), part(pair, 4))))
        .when(one.isNotNull(), with_unit(F.concat(F.lit("$"), one), part(f"(?i){_CHIP}", 2)))
        .otherwise(F.left(t, F.lit(60)))
    )


def range_salary(low: Column, high: Column, unit: Column) -> Column:
    """Pay of structured data: whole numbers with thousands separators; null without a lower bound."""
    number = lambda c: F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("long")
    lo, hi = F.nullif(number(low), F.lit(0)), F.nullif(number(high), F.lit(0))
    after = F.when(F.length(text(unit)) > 0, F.concat(F.lit(" "), unit)).otherwise("")
    shown = lambda n: F.concat(F.lit("$"), F.format_number(n, 0))
    return F.when(lo.isNotNull(), F.concat(F.when(hi.isNotNull(), F.concat(shown(lo), F.lit("–"), shown(hi))).otherwise(shown(lo)), after))
