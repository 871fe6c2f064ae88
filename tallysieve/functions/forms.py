"""Application forms: which profile field a label asks for, and which option an answer names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysieve.functions.text import let, or_null, stripped, text

#: Label patterns and the profile field that each asks for; the first that fits holds.
FIELD_RULES = (
    (r"preferred.*first.*name", "first_name"),
    (r"legal.*first.*name", "legal_first_name"),
    (r"\bfirst.*name\b", "first_name"),
    (r"\bmiddle.*name\b", "middle_name"),
    (r"\blast.*name\b|\bsurname\b|\bfamily.*name\b", "last_name"),
    (r"\be-?mail\b", "email"),
    (r"\bphone\b|\bmobile.*number\b|\btelephone\b", "phone"),
    (r"\bstreet\b|\baddress.*line|\bhome.*address\b", "address_street"),
    (r"\bcity\b", "address_city"),
    (r"\bstate\b|\bprovince\b", "address_state"),
    (r"\bzip\b|\bpostal.*code\b", "address_zip"),
    (r"reside.*united states|reside.*u\.?s\.?\b|located.*united states", "resides_in_us"),
    (r"\bcountry\b", "address_country"),
    (r"linkedin", "linkedin_url"),
    (r"github", "github_url"),
    (r"portfolio|personal.*website|website\b", "portfolio_url"),
    (r"\bschool\b|\buniversity\b|\bcollege\b", "school"),
    (r"\bdegree\b", "degree"),
    (r"major|field.*of.*study|discipline", "major"),
    (r"graduation.*date|grad.*date|when.*graduat", "graduation_month"),
    (r"sponsor(ship)?", "requires_sponsorship"),
    (r"citizen|authorized.*work|work.*authorization", "us_citizen"),
    (r"desired.*salary|salary.*expect|compensation.*expect", "desired_salary"),
    (r"start.*date|available.*start|availability", "available_start_date"),
    (r"relocat", "willing_to_relocate"),
    (r"\bgender\b|\bsex\b", "gender"),
    (r"race|ethnicity", "race_ethnicity"),
    (r"veteran", "veteran_status"),
    (r"disability", "disability_status"),
)
#: Labels that look like a field's but ask for what no profile has.
UNROUTED = (
    r"address\s*(?:line\s*)?(?:2|two|ii)\b|\baddress\s*2\b|\bapt\.?\b|\bapartment\b|\bsuite\b|\bste\.?\s*#|\bunit\s*(?:#|no\.?|number)\b"
    r"|\bfloor\b|\bbuilding\s*(?:name|number|#)|level of (?:experience|proficiency|expertise)|years? of experience|best describes your"
    r"|how (?:would you )?(?:rate|proficient)|\bproficiency\b|rate your\b"
)
#: Option labels that mean that nothing is chosen.
UNCHOSEN = (
    r"^[-–—\s]*(?:please\s+)?(?:select|choose|pick)(?:\s+(?:an?|one|your|the))?(?:\s+(?:option|value|item|choice|one))?[-–—\s.]*$"
    r"|^[-–—\s]*$|^none$|^n/?a$"
)
#: The parts of a profile that forms ask for.
PROFILE_SCHEMA = (
    "personal struct<preferred_first_name:string,legal_first_name:string,middle_name:string,last_name:string,email:string,phone:string,"
    "address:struct<street:string,city:string,state:string,zip:string,country:string>,linkedin_url:string,github_url:string,portfolio_url:string>,"
    "education struct<school:string,degree:string,major:string,graduation_month:string,graduation_year:string>,"
    "work_authorization struct<us_citizen:boolean,requires_sponsorship:boolean>,"
    "logistics struct<desired_salary:string,available_start_date:string,willing_to_relocate:boolean>,"
    "eeo_demographics struct<gender:string,race_ethnicity:string,veteran_status:string,disability_status:string>"
)
TO_FILL = "FILL_IN"


def yes_no(flag: Column) -> Column:
    """Yes or No; what a profile doesn't say stays null."""
    return F.when(flag, "Yes").when(~flag, "No")


def profile_values(profile: Column) -> Column:
    """A profile, as JSON, as a map of field and value; fields without a value are left out."""

    def flat(p: Column) -> Column:
        person, place = p["personal"], p["personal"]["address"]
        work, plans = p["work_authorization"], p["logistics"]
        values = {
            "first_name": F.coalesce(or_null(person["preferred_first_name"]), person["legal_first_name"]),
            **{n: person[n] for n in ("legal_first_name", "middle_name", "last_name", "email", "phone", "linkedin_url", "github_url", "portfolio_url")},
            **{f"address_{n}": place[n] for n in ("street", "city", "state", "zip", "country")},
            "resides_in_us": yes_no(or_null(place["country"]) == "United States"),
            **{n: p["education"][n] for n in ("school", "degree", "major", "graduation_month", "graduation_year")},
            "us_citizen": yes_no(work["us_citizen"]),
            "requires_sponsorship": yes_no(work["requires_sponsorship"]),
            "desired_salary": plans["desired_salary"],
            "available_start_date": plans["available_start_date"],
            "willing_to_relocate": yes_no(plans["willing_to_relocate"]),
            **{n: p["eeo_demographics"][n] for n in ("gender", "race_ethnicity", "veteran_status", "disability_status")},
        }
        pairs = [F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in values.items()]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda x: text(x["value"]) != ""))

    return let(F.from_json(profile, PROFILE_SCHEMA), flat)


def field_of(label: Column) -> Column:
    """The profile field that a form label asks for; null if none does."""

    def routed(t: Column) -> Column:
        found = F.when((t == "") | F.rlike(t, F.lit("(?i)" + UNROUTED)), None)
        for pattern, field in FIELD_RULES:
            found = found.when(F.rlike(t, F.lit("(?i)" + pattern)), field)
        return found

    return let(stripped(text(label)), routed)


def answer(label: Column, values: Column) -> Column:
    """(field, value) for a label from a profile's map; null if the profile has no value, as nothing is made up."""
    return let(field_of(label), lambda f: F.when(F.element_at(values, f).isNotNull(), F.struct(f.alias("field"), F.element_at(values, f).alias("value"))))


def folded(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(stripped(F.regexp_replace(text(c), r"(?U)\s+", " ")))


def is_unchosen(label: Column) -> Column:
    return F.rlike(folded(label), F.lit("(?i)" + UNCHOSEN))


def option_names(label: Column) -> Column:
    """The names that an option answers to: all of it, its first sentence with and without the stop, and what is before a comma."""

    def names(n: Column) -> Column:
        head = F.trim(F.substring_index(n, ".", 1))
        lead = F.trim(F.substring_index(F.substring_index(n, ",", 1), ".", 1))
        own = lambda c: (c != "") & (c != n)
        return F.array_distinct(F.array_compact(F.array(n, F.when(own(head), head), F.when(own(head), F.concat(head, F.lit("."))), F.when(own(lead), lead))))

    return let(folded(label), names)


def best_key(value: Column, keys: Column) -> Column:
    """The key of an array that a value is or, failing that, the longest that it starts with; null if none."""

    def chosen(v: Column) -> Column:
        starts = F.filter(keys, lambda k: F.startswith(v, k))
        longest = F.get(F.array_sort(starts, lambda a, b: F.length(b) - F.length(a)), F.lit(0))
        return F.when(F.array_contains(keys, v), v).otherwise(longest)

    return let(folded(value), chosen)


def repeat_cell(field_id: Column) -> Column:
    """(group, column, row) of a field in a repeated group; null for others, as ids of two parts are plain questions."""
    parts = F.split(text(field_id), "-")
    return F.when((F.size(parts) == 3) & F.rlike(parts[2], F.lit("^[0-9]+$")), F.struct(parts[0].alias("group"), parts[1].alias("column"), parts[2].alias("row")))


def avatar_letter(company: Column) -> Column:
    """A company's initial, past any signs before its first letter."""
    # Signs beyond the basic plane are no letters here.
    plain = F.regexp_replace(F.regexp_replace(text(company), r"[\x{10000}-\x{10FFFF}]", ""), r"^[^A-Za-z0-9_À-￿]+", "")
    return F.upper(F.coalesce(or_null(F.left(stripped(plain), F.lit(1))), F.lit("?")))
