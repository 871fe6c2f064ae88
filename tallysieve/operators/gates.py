"""Title gates: cheap rejections before a posting is read in full."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.text import text

#: Title signals.
SENIOR = ("senior", "sr", "staff", "lead", "principal", "director", "manager", "head of", "vp", "vice president", "architect", "fellow", "distinguished", "executive")
SENIOR_HOURLY = ("principal", "director", "head of", "vp", "vice president", "architect", "fellow", "distinguished")
SENIOR_LOCAL = ("senior", "sr", "principal", "director", "manager", "head of", "vp", "vice president", "architect", "fellow", "distinguished")
NEW_GRAD = ("new grad", "new graduate", "new college grad", "college grad", "ncg", "university grad", "university graduate", "recent grad", "recent graduate")
INTERN = r"\bintern(?:ship)?s?(?![a-z0-9])|\bco[\s-]?ops?(?![a-z0-9])|\bapprentice(?:ship)?s?(?![a-z0-9])|\bsummer\s+analyst\b|\bsummer\s+associate\b|\btrainee\b"
STUDENT = r"\bstudent\b|\bwork[\s-]?study\b"
SOFTWARE = r"(?i)software|developer|programmer|engineer|web|application|comput|data|\bIT\b|front.?end|back.?end|full.?stack|\bqa\b|test"
STUDENT_OFFICE = r"student\s+(?:affairs|loan|services|success|life|housing|health|union|center|records|accounts|conduct)"
INTERN_OR_STUDENT = r"\bintern(?:ship)?s?\b|\bco[\s-]?ops?\b|\bapprentice(?:ship)?s?\b|\bnew\s+grad(?:uate)?\b|\bstudent\s+(?:worker|program)\b"
EXPERIENCED = r"(?i)\b(?:ii|iii|iv|v)\b|\blevel\s*[2-5]\b|\bl[2-5]\b"


def any_phrase(title: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(text(title)).rlike(r"\b(?:" + "|".join(phrases) + r")\b")


def is_senior(title: Column, signals: tuple[str, ...] = SENIOR) -> Column:
    return any_phrase(title, signals)


def is_new_grad(title: Column) -> Column:
    return any_phrase(title, NEW_GRAD)


def is_student_worker(title: Column) -> Column:
    """A student is hired for software work; an office for students is something else."""
    t = F.lower(text(title))
    return ~t.rlike(STUDENT_OFFICE) & t.rlike(STUDENT) & t.rlike(SOFTWARE)


def is_internship(title: Column) -> Column:
    return F.lower(text(title)).rlike(INTERN) | is_student_worker(title)


@dataclass(frozen=True)
class Gate:
    """A rejection with its reason, for the sources named (all if none)."""

    reason: str
    rejects: object
    only: tuple[str, ...] = ()


#: Rule sets by tenant: internships, hourly work, one metro area.
GATES = {
    "internships": (
        Gate("Senior-level title", is_senior, ("search", "board")),
        Gate("New-graduate role", is_new_grad, ("search", "board")),
        Gate("No internship marker in title", lambda t: ~is_internship(t), ("search", "board")),
    ),
    "hourly": (
        Gate("Senior-level title", lambda t: is_senior(t, SENIOR_HOURLY)),
        Gate("Internship or student role", lambda t: F.lower(text(t)).rlike(INTERN_OR_STUDENT)),
    ),
    "local": (
        Gate("Senior-level title", lambda t: is_senior(t, SENIOR_LOCAL)),
        Gate("New-graduate role", is_new_grad),
        Gate("Experienced level", lambda t: text(t).rlike(EXPERIENCED)),
    ),
}


def source_of(row_id: Column) -> Column:
    """Where a row came from, by its id: search site, list or board."""
    return F.when(row_id.startswith("gh:"), "list").when(row_id.startswith("ats:"), "board").otherwise("search")


def gate_reason(title: Column, source: Column, gates: tuple[Gate, ...] = GATES["internships"]) -> Column:
    """The first gate's reason; null if the title passes."""
    reasons = [F.when(g.rejects(title) & (source.isin(*g.only) if g.only else F.lit(True)), g.reason) for g in gates]
    return F.coalesce(*reasons)


def gated(postings: DataFrame, gates: tuple[Gate, ...] = GATES["internships"]) -> DataFrame:
    """Rows with gate_reason and, where a gate rejects, tier INELIGIBLE and that reason."""
    reason = gate_reason(F.col("title"), source_of(F.col("id")), gates)
    out = postings.withColumn("gate_reason", reason)
    hit = F.col("gate_reason").isNotNull()
    return out.withColumn("tier", F.when(hit, "INELIGIBLE").otherwise(F.col("tier"))).withColumn("reason", F.when(hit, F.col("gate_reason")).otherwise(F.col("reason")))
