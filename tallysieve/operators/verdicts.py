"""Deterministic rules that correct a classifier's verdict, in a fixed order.

Each rule takes the posting and the verdict so far.  The order matters: the
insider gate, full-time, school, degree and place rules reject; the pay rule fills
a gap; list rows are lifted unless the rejection is hard; last, a verdict from a
title alone loses its certainty.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.salary import extract_salary
from tallysieve.functions.text import flat_markup, let, norm_school, or_null, stripped, text


@dataclass(frozen=True)
class Profile:
    """The person that postings are judged for."""

    school: str = "Example State University"
    home_regions: tuple[str, ...] = ("Example State", "Example City")
    degree: str = "BS"


MIN_DESCRIPTION = 200
PERK_LOOK_BACK = 80
QUOTE = 160

#: Patterns of the rules.
FULL_TIME = r"(?i)\bfull[\s-]time\s+(position|role|employee|employment|hire)\b|\bpermanent\s+(position|role|employee)\b"
INTERNSHIP_WORD = r"(?i)\bintern(ship)?s?\b|\bco[\s-]?op\b"
_SCHOOL = r"(?:[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}\s+(?:University|College)|(?:University|College)\s+of\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2})"
_SCHOOL_LOOSE = (
    r"(?:[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}\s+(?:University|College|Tech|Institute(?:\s+of\s+Technology)?)"
    r"|(?:University|College)\s+of\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2}|[A-Z]{2,5}(?=\s*$|\s*[|,–—-]))"
)
_COOP = r"[Cc]o[\s-]?[Oo]p"
_COOP_SCHOOLS = "Drexel|Northeastern|Waterloo|Kettering|Purdue|Cincinnati|Wentworth|RIT|Rochester Institute|Georgia Tech|Virginia Tech|Cal Poly"
SCHOOL_RULES = (
    r"\b(?:[A-Z][A-Za-z&.,-]*)['’]s\s+((?:[A-Z][A-Za-z]+\s+)??[A-Z][A-Za-z]+)\s+" + _COOP + r"\s+[Pp]rogram\b",
    r"\b" + _COOP + r"\s+(?:[Pp]rogram\s+)?with\s+(" + _SCHOOL + r")\b",
    r"\b(" + _SCHOOL_LOOSE + r")\s+" + _COOP + r"\s*[:\-–—]",
    r"\b" + _COOP + r"\s*[|/–—]\s*(" + _SCHOOL_LOOSE + r")",
    r"\b[Pp]ursuing\s+(?:a|an|your)?\s*(?:[\w'’]+\s+)??degree\b(?:\s+in\s+[A-Za-z][A-Za-z\s]{0,40}?)?\s+from\s+(" + _SCHOOL + r")\b",
    r"\b(" + _COOP_SCHOOLS + r")\s+" + _COOP + r"\b",
)
_GRADUATE = r"(?:MS|M\.S\.|master'?s|Ph\.?D\.?|doctoral|graduate)"
GRADUATE_ONLY = r"(?i)\b(?:pursuing|enrolled in|completing)\s+(?:an?\s+)?" + _GRADUATE + r"(?:\s*(?:,|or|/)\s*" + _GRADUATE + r"){0,2}\s+(?:degree|program)\b"
UNDERGRADUATE = r"(?i)\bbachelor|undergraduate|\bB\.?S\.?\b"
HOME_STATE = (
    r"\b(?:AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|"
    r"TN|TX|UT|VT|VA|WA|WV|WI|WY|DC|PR)\b"
)
HOME_WORD = r"(?i)united states|\bU\.?S\.?A?\b|remote[\s,-]*(?:us|usa|united states)"
FOREIGN = (
    r"(?i)\b(?:india|canada|united kingdom|england|scotland|wales|ireland|germany|france|spain|italy|portugal|netherlands|belgium|poland|"
    r"czech|hungary|romania|sweden|norway|denmark|finland|switzerland|austria|greece|turkey|israel|egypt|nigeria|kenya|south africa|uae|"
    r"qatar|saudi|singapore|malaysia|thailand|vietnam|philippines|indonesia|japan|korea|china|hong kong|taiwan|australia|new zealand|"
    r"brazil|argentina|chile|colombia|peru|mexico|london|manchester|edinburgh|dublin|cambridge|oxford|bristol|leeds|glasgow|toronto|"
    r"vancouver|montreal|ottawa|calgary|waterloo|bengaluru|bangalore|hyderabad|mumbai|delhi|pune|chennai|noida|gurgaon|indore|kolkata|"
    r"berlin|munich|hamburg|frankfurt|paris|lyon|madrid|barcelona|lisbon|amsterdam|rotterdam|brussels|zurich|geneva|vienna|prague|"
    r"warsaw|budapest|bucharest|stockholm|oslo|copenhagen|helsinki|dubai|tel aviv|shanghai|beijing|shenzhen|tokyo|osaka|seoul|sydney|"
    r"melbourne|auckland|sao paulo|bogota)\b"
)
TITLE_GATES = (
    ("company's own intern-conversion req", r"(?i)\bintern(?:ship)?\s+conversions?\b"),
    ("returning-intern-only req", r"(?i)\breturning\s+(?:(?:summer|winter|fall|spring|20\d\d)\s+){0,2}(?:intern|co[\s-]?op|analyst|associate|scholar|trainee)s?\b"),
    ("DoD SkillBridge (active-duty service members only)", r"(?i)\bskill\s?bridge\b"),
    ("military-status-only posting", r"(?i)\b(?:active[\s-]?duty|military|veterans?|service\s?members?)\s+only\b"),
)
RESTRICTED = (
    r"(?i)\b(?:this|the)\s+(?:requisition|job\s+posting|posting|position|role|opportunity|opening)\s+(?:is\s+)?(?:only\s+)?"
    r"(?:for|open(?:\s+only)?\s+to|intended\s+(?:only\s+)?for|restricted\s+to|limited\s+to|reserved\s+for|available\s+(?:only\s+)?to|"
    r"offered\s+(?:only\s+)?to|designated\s+for)\b[^.]{0,80}?(?:\binterns?\s+(?:who\s+(?:is|are)\s+)?returning\b"
    r"|\b(?:returning|current|former|previous|existing|internal|20\d\d)\b[^.;]{0,60}?\b(?:interns?|co[\s-]?ops?|employees?|contract\s+workers?)\b"
    r"|\bwho\s+(?:have\s+)?(?:already\s+)?(?:been\s+)?(?:officially\s+)?(?:selected|pre-selected|invited|interviewed|attended|met\s+with)\b)"
)
INTERNS_ONLY = (
    r"(?i)\b(?:current|former|returning|previous|existing|internal|20\d\d)(?:\s*[/&,]\s*(?:current|former|returning|previous|existing|internal))?"
    r"(?:\s+[A-Za-z][\w.&'’-]*){0,3}\s+interns?\s+only\b"
)
PERK = r"(?i)\b(?:housing|meals?|lunch|discounts?|perks?|benefits?|swag|parking|insurance|401\s?k|stipend|events?|socials?|networking|provided|offered|available|free|gym|shuttle)\b"
NAMED_GROUP = r"\b((?:[A-Z][A-Za-z&.\-]*\s+){1,3})(?:Co[\s-]?[Oo]ps?|Interns?)\s+[Oo]nly\b"
GENERIC_GROUP = (
    "summer", "winter", "fall", "spring", "autumn", "full", "part", "time", "paid", "unpaid", "new", "all", "the", "our", "your", "and",
    "for", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "student", "students",
)
TEXT_GATES = (
    ("internal candidates only", r"(?i)\b(?:internal|current)\s+(?:candidates?|applicants?)\s+only\b"),
    ("applications outside the stated audience are not considered", r"(?i)\boutside\s+(?:of\s+)?th(?:is|e)\s+audience\b"),
    (
        "non-interns explicitly will not be considered",
        r"(?i)\b(?:applicants?|candidates?|those|anyone|students?)\s+who\s+(?:were|was|are|is|did)\s+not\b[^.]{0,60}?"
        r"\b(?:current|former|returning|previous|20\d\d)\b[^.]{0,40}?\binterns?\b[^.]{0,60}?\bwill\s+not\s+be\s+considered\b",
    ),
    (
        "requires being that company's current/former intern",
        r"(?i)\bmust\s+(?:be|have\s+been)\s+(?:a|an)\s+(?:current|former|returning|previous|existing|20\d\d)\b[^.;]{0,60}?(?-i:[A-Z][\w&.\-]*)\s+[Ii]nterns?\b",
    ),
)
PRIOR_INTERNSHIP = (
    r"\b(?:successfully\s+)?completed\s+(?:an?\s+)?(?:prior\s+|previous\s+)?internship\s+(?:with|at)\s+"
    r"(us\b|our\s+(?:company|team|firm|organi[sz]ation)\b|[A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,3})\s+in\s+20\d\d\b"
)
VETERAN_TITLE = r"(?i)\bOVIP\b|\b(?:veterans?|military)\s+(?:internship|intern|fellowship)\b"
VETERAN_TEXT = r"(?i)\b(?:veterans?|military)\s+(?:internship|intern)\s+program\b"
MILITARY = (
    r"(?i)\bwithin\s+180\s+days\s+of\s+(?:separation|retirement|transition)\b|\b(?:currently|must\s+be|are)\s+(?:serving\s+)?on\s+active\s+duty\b"
    r"|\bactive[\s-]?duty\s+service\s?members?\s+only\b"
)
REGION = r"\benrolled\s+at\s+(?:a\s+)?(?:universit(?:y|ies)|colleges?|schools?|institutions?)\s+in\s+((?:the\s+)?[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)"
HOME_COUNTRY = r"U\.?S\.?A?|United\s+States|North\s+America|America"

#: What a text must have, in lower case, for a pattern above to match: one word of each group.
NEEDS = {
    "titles": (("conversion",), ("returning",), ("skill",), ("only",)),
    "restricted": (("requisition", "posting", "position", "role", "opportunity", "opening"), ("returning", "current", "former", "previous", "existing", "internal", "20", "who")),
    "texts": (("only",), ("audience",), ("considered",), ("must",)),
    "military": ("180", "duty"),
    "full": ("full", "permanent"),
    "degree": ("pursuing", "enrolled", "completing"),
}

GROUP_LABELS = {
    "restricted": "requisition restricted to a named insider group",
    "interns": "open to that company's own interns only",
    "named": "restricted to a named group the candidate is not in",
    "prior": "requires a prior internship at this same employer",
    "veteran": "veteran/military-spouse internship programme",
    "military": "requires active-duty military status",
    "region": "restricted to students enrolled outside the US",
}


def has(low: Column, *words: str) -> Column:
    """Whether a lower-case text has one of the words: a look that spares most texts a pattern."""
    return reduce(operator.or_, (low.contains(w) for w in words))


def first_allowed(c: Column, pattern: str, allowed: Callable[[Column, Column], Column]) -> Column:
    """The first match that ``allowed(match, the 80 characters before it)`` takes; null if none.

    All matches are folded with the pieces between them, so a match that is not
    allowed doesn't end the search.
    """
    hits = F.regexp_extract_all(c, F.lit(pattern), 0)
    pieces = F.slice(F.split(c, pattern, -1), F.lit(1), F.size(hits))
    start = F.struct(F.lit("").alias("before"), F.lit(None).cast("string").alias("found"))

    def fold(acc: Column, x: Column) -> Column:
        before = F.concat(acc["before"], x["piece"])
        found = F.coalesce(acc["found"], F.when(allowed(x["hit"], F.right(before, F.lit(PERK_LOOK_BACK))), x["hit"]))
        return F.struct(F.right(F.concat(before, x["hit"]), F.lit(2 * PERK_LOOK_BACK)).alias("before"), found.alias("found"))

    # Few texts match at all; the rest need one look.
    return F.when(c.rlike(pattern), F.aggregate(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), start, fold)["found"])


def insider_gate(title: Column, description: Column, company: Column, profile: Profile = Profile()) -> Column:
    """A struct of label and quote of the first sign that a posting is only for a closed group; null if open."""
    facts = F.struct(flat_markup(title).alias("t"), flat_markup(F.concat(text(title), F.lit(" . "), text(description))).alias("body"))
    return let(facts, lambda x: let(F.lower(x["body"]), lambda low: _gate_of(x["t"], x["body"], low, company, profile)))


def _gate_of(t: Column, body: Column, low: Column, company: Column, profile: Profile) -> Column:
    hit = lambda c, p: or_null(F.regexp_extract(c, p, 0))
    school = norm_school(F.lit(profile.school))
    no_perk = lambda _, before: ~before.rlike(PERK)

    def names_other_group(match: Column, before: Column) -> Column:
        who = F.regexp_extract(match, NAMED_GROUP, 1)
        generic = F.forall(F.regexp_extract_all(F.lower(who), F.lit("[a-z]+"), 0), lambda w: w.isin(*GENERIC_GROUP))
        return (norm_school(who) != school) & ~generic & no_perk(match, before)

    def is_abroad(match: Column, _: Column) -> Column:
        home = "|".join([HOME_COUNTRY, *(r.replace(" ", r"\s+") for r in profile.home_regions)])
        return ~F.regexp_extract(match, REGION, 1).rlike(rf"(?i)\b(?:{home})\b")

    named = F.regexp_extract(body, PRIOR_INTERNSHIP, 1)
    three = lambda c: F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z]{3,}"), 0)
    same_employer = F.lower(named).rlike("^(us|our)") | F.arrays_overlap(three(named), three(company))
    subject, who = NEEDS["restricted"]
    rules = [(label, F.when(has(F.lower(t), *words), hit(t, p))) for (label, p), words in zip(TITLE_GATES, NEEDS["titles"], strict=True)]
    rules += [
        (GROUP_LABELS["restricted"], F.when(has(low, *subject) & has(low, *who), hit(body, RESTRICTED))),
        (GROUP_LABELS["interns"], F.when(has(low, "only"), first_allowed(body, INTERNS_ONLY, no_perk))),
        (GROUP_LABELS["named"], F.when(has(low, "only"), first_allowed(body, NAMED_GROUP, names_other_group))),
    ]
    rules += [(label, F.when(has(low, *words), hit(body, p))) for (label, p), words in zip(TEXT_GATES, NEEDS["texts"], strict=True)]
    rules += [
        (GROUP_LABELS["prior"], F.when(has(low, "completed") & body.rlike(PRIOR_INTERNSHIP) & same_employer, hit(body, PRIOR_INTERNSHIP))),
        (GROUP_LABELS["veteran"], F.when(t.rlike(VETERAN_TITLE), hit(body, VETERAN_TEXT))),
        (GROUP_LABELS["military"], F.when(has(low, *NEEDS["military"]), hit(body, MILITARY))),
        (GROUP_LABELS["region"], F.when(has(low, "enrolled"), first_allowed(body, REGION, is_abroad))),
    ]

    def labelled(label: str) -> Callable[[Column], Column]:
        return lambda x: F.when(x.isNotNull(), F.struct(F.lit(label).alias("label"), x.alias("quote")))

    return F.coalesce(*(let(quote, labelled(label)) for label, quote in rules))


def restricted_school(title: Column, description: Column, profile: Profile = Profile()) -> Column:
    """The school whose students alone may apply; null if none or the profile's own."""
    both = F.concat(text(title), F.lit("\n"), text(description))
    # Each rule names a co-op, but for the one of a degree.
    needs = lambda b, p: b.contains("degree") if "degree" in p else F.rlike(b, F.lit(_COOP))
    name = let(both, lambda b: stripped(F.coalesce(*(F.when(needs(b, p), or_null(F.regexp_extract(b, p, 1))) for p in SCHOOL_RULES))))
    return let(name, lambda n: F.when(norm_school(n) != norm_school(F.lit(profile.school)), n))


def is_full_time_only(description: Column) -> Column:
    d = text(description)
    return has(F.lower(d), *NEEDS["full"]) & d.rlike(FULL_TIME) & ~d.rlike(INTERNSHIP_WORD)


def is_graduate_only(description: Column) -> Column:
    d = text(description)
    return has(F.lower(d), *NEEDS["degree"]) & d.rlike(GRADUATE_ONLY) & ~d.rlike(UNDERGRADUATE)


def foreign_place(location: Column) -> Column:
    """The foreign place a location names without any home option; null otherwise."""
    loc = text(location)
    return F.when(~loc.rlike(HOME_STATE) & ~loc.rlike(HOME_WORD), or_null(F.regexp_extract(loc, FOREIGN, 0)))


def corrected(postings: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """``postings`` with tier, reason, salary and hard_ineligible after all rules."""
    c = F.col
    found = F.struct(
        insider_gate(c("title"), c("description"), c("company"), profile).alias("__insider"),
        is_full_time_only(c("description")).alias("__full"),
        restricted_school(c("title"), c("description"), profile).alias("__school"),
        is_graduate_only(c("description")).alias("__degree"),
        foreign_place(c("location")).alias("__place"),
        extract_salary(c("description")).alias("__pay"),
    )
    # Generating one row keeps the optimizer from copying these long expressions to each place of use.
    facts = postings.select("*", F.inline(F.array(found)))
    judged = c("tier").isin("APPLY", "APPLY_CAVEAT", "INELIGIBLE")
    open_ = c("tier").isin("APPLY", "APPLY_CAVEAT")
    gate = c("__insider").isNotNull() & judged
    # The first rule that rejects an open verdict ends the rejections: later ones need an open verdict.
    rejected = (
        F.when(open_ & gate, F.concat(F.lit("Overridden: this posting is restricted to a group the candidate is not in ("), c("__insider.label"), F.lit(') — "'), F.left(F.trim(c("__insider.quote")), F.lit(QUOTE)), F.lit('".')))
        .when(open_ & c("__full"), F.lit("Overridden: description explicitly states this is a full-time/permanent position, with no internship/co-op language anywhere in the posting."))
        .when(open_ & c("__school").isNotNull(), F.concat(F.lit("Overridden: this co-op is restricted to students currently enrolled at "), c("__school"), F.lit(f", not {profile.school}.")))
        .when(open_ & c("__degree"), F.lit(f"Overridden: description requires current enrollment in a graduate-level (MS/PhD) program, with no bachelor's/undergraduate alternative mentioned — candidate is a {profile.degree} student."))
        .when(open_ & c("__place").isNotNull(), F.concat(F.lit("Overridden: this role is based in "), F.initcap(c("__place")), F.lit(" with no US or US-remote option stated; candidate is a US citizen without the right to work there.")))
    )
    hard = gate | (open_ & ~c("__full") & (c("__school").isNotNull() | c("__degree") | c("__place").isNotNull()))
    kept = [n for n in postings.columns if n != "hard_ineligible"]
    staged = facts.select(*kept, "__pay", F.inline(F.array(F.struct(rejected.alias("__why"), F.coalesce(hard, F.lit(False)).alias("hard_ineligible")))))
    tier = F.when(c("__why").isNotNull(), "INELIGIBLE").otherwise(c("tier"))
    lifted = F.when(c("id").startswith("gh:") & (tier == "INELIGIBLE") & ~c("hard_ineligible"), "APPLY_CAVEAT").otherwise(tier)
    thin = (lifted == "APPLY") & (F.length(stripped(text(c("description")))) < MIN_DESCRIPTION)
    return staged.select(
        *(n for n in kept if n not in ("tier", "reason", "salary")),
        F.when(thin, "APPLY_CAVEAT").otherwise(lifted).alias("tier"),
        F.when(thin, "Classified on title only — no description available").otherwise(F.coalesce("__why", "reason")).alias("reason"),
        F.coalesce(or_null(c("salary")), c("__pay")).alias("salary"),
        "hard_ineligible",
    )


def error_kind(exception: Column, message: Column) -> Column:
    """Whether a classifier's failure is about billing, credentials or passing trouble."""
    m = F.lower(text(message))
    no_credit = m.contains("credit balance") | m.contains("insufficient credit")
    return F.when((exception == "BadRequestError") & no_credit, "billing").when(exception.isin("AuthenticationError", "PermissionDeniedError"), "auth").otherwise("transient")
