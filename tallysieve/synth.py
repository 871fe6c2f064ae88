"""Synthetic postings derived from ``orders``, for queries over the test tables.

Every field is picked from a fixed list by arithmetic on the order's keys, so Spark
and any SQL engine make the same rows.  One recipe gives both: ``select_list`` writes
the projection in either dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_S = 1_735_689_600
#: Rows that one task makes into postings: rules over texts take up to half a millisecond a row.
TASK_ROWS = 50_000
FIRST = ("Acme", "Birch", "Cobalt", "Dune", "Ember", "Fjord", "Grove", "Harbor", "Iris", "Juniper", "Kestrel", "Lumen", "Maple", "Nimbus", "Orchid", "Pioneer", "Quartz", "Ridge", "Summit", "Tidal")
SECOND = ("line", "works", "field", "stone", "wave", "forge", "path", "light", "gate", "bridge", "crest", "haven", "point", "shore", "well", "wood", "yard", "loft", "mill", "peak")
FORMS = ("{} Inc", "The {} Company", "{}'s", "{} (YC W21)", "{} Technologies, Inc.", "{}", "{} LLC", "{} Group Holdings")
TITLES = (
    "Software Engineer Intern", "Software Engineer Intern - Summer 2026", "Software Engineer Intern (Fall 2026)", "Software Engineering Co-op_Summer 2027",
    "Data Science Intern, Spring 2026", "Senior Software Engineer", "Staff Data Engineer", "New Grad Software Engineer", "Backend Engineer Intern",
    "Front End Developer Internship", "Full-Stack Engineer Intern", "Machine Learning Intern", "AI Research Intern", "Cloud Platform Intern - Summer 2026",
    "Security Engineering Intern", "Software Engineer Student Assistant", "Software Engineer II - Student Affairs", "Student Web/Application Developer",
    "Work-Study IT Support", "Head of Product", "VP Engineering", "Solutions Architecture Intern", "Fellowship Intern", "Software Engineer II", "Developer Level 3",
    "QA Test Automation Intern", "Embedded Firmware Intern", "Data Analyst Summer Associate", "Student Trainee (AI Data Engineer)", "Product Manager Intern",
    "Returning Summer Analyst", "Intern Conversion: Software Developer", "DoD SkillBridge Software Intern", "Internship - Active Duty Only", "Military Intern - Software",
    "Software Engineer Co-Op | Lakeside University", "Lakeside University Co-op: Software", "Mobile Developer Intern, Austin TX", "Site Reliability Intern OH",
    "Apprentice Programmer", "Associate Machine Learning Engineer", "Software Engineer, Autumn 2026 Intern",
)
LOCATIONS = (
    "Austin, TX", "New York, NY", "New York City, NY", "London, UK", "Toronto, Canada", "Berlin, Germany", "Remote - United States", "Austin, TXFort Mill, SC",
    "London, UKParis, France", "21 Locations", "21 locationsBoston, MASanta Ana, CA", "Seattle, WA; Portland, OR", "McLean, VA", "", "Bengaluru, India", "Remote in US",
    "Atlanta, GA · Dallas, TX", "Denver, CO +2",
)
LONG = " We build tools that people use every day and look for curious students who like to learn, write clear code, test it well and talk about it with others in a small team across several projects and offices."
TEXTS = (
    "Short text.",
    "Pay is $25/hr - $35/hr for this internship." + LONG,
    "The range is $80,000 - $120,000 per year for interns." + LONG,
    "Tuition reimbursement up to $10,000 for interns." + LONG,
    "Earn $ 25.00 to $40.00 per hour as an intern." + LONG,
    "Salary $120K for interns." + LONG,
    "A signing bonus of $5K and a base of $95,000 for interns." + LONG,
    "This is a full-time position in our office." + LONG,
    "This internship may become a full time role." + LONG,
    "Must be enrolled in a master's degree program. Interns welcome." + LONG,
    "Enrolled in a graduate program or a bachelor program; interns welcome." + LONG,
    "Acme's Drexel Co-op Program gives students six months." + LONG,
    "Technology Co-op with Lakeside University in town." + LONG,
    "Technology Co-op with Example State University in town." + LONG,
    "Currently pursuing a bachelor's degree from Lakeside University, as an intern." + LONG,
    "This requisition is open to 2026 Acme Interns only." + LONG,
    "Housing is provided for our 2026 summer interns only. Apply now as an intern." + LONG,
    "Housing is free for our 2026 summer interns only. For current Acme Interns only." + LONG,
    "For internal candidates only; interns." + LONG,
    "Applications outside of this audience are not read; interns." + LONG,
    "Must be a current Acme intern." + LONG,
    "You have completed an internship with us in 2025." + LONG,
    "You have completed an internship with Zenith Corp in 2025." + LONG,
    "Must be on active duty or within 180 days of separation; intern." + LONG,
    "Students enrolled at a university in Germany may apply for this internship." + LONG,
    "Students enrolled at a university in the United States may apply for this internship." + LONG,
    "Our veteran internship program welcomes you as an intern." + LONG,
    "<p>This posting is for <b>current employees</b> and interns.</p><li>Learn</li>" + LONG,
    "(Lakeside Interns Only) Join the intern class." + LONG,
    "(Summer Interns Only) Join the intern class." + LONG,
    "Weekly pay $4,000.00/wk for interns." + LONG,
    "Plain internship text." + LONG,
)
URLS = (
    "https://www.linkedin.com/jobs/view/software-engineer-{}?trk=feed",
    "https://www.linkedin.com/jobs/view/{}/",
    "https://boards.greenhouse.io/acme/jobs/{}?gh_src=abc",
    "https://boards.greenhouse.io/embed/job_app?gh_jid={}&ref=x",
    "https://acme.wd5.myworkdayjobs.com/en-US/careers/job/Austin/Intern_JR-{}-1",
    "https://acme.wd5.myworkdayjobs.com/careers/job/Austin/Intern_R{}",
    "https://jobs.lever.co/acme/1234abcd-0000-4000-8000-0000{}0/apply?lever-source=x",
    "https://jobs.ashbyhq.com/Acme/1234abcd-0000-4000-8000-0000{}0",
    "https://www.careers.example.com/Jobs/{}/?utm_source=feed&b=2&a=1",
    "https://careers.example.com/jobs/{}?a=1&b=2",
    "https://jobs.smartrecruiters.com/Acme/74300{}-intern/",
    "https://careers-acme.icims.com/jobs/{}/intern/job?mode=view",
    "not a url {}",
    "https://careers.example.com/austin-tx/intern/{}",
)
SALARIES = ("", "$25/hr - $35/hr", "$80,000 - $120,000/yr", "$4,000.00/wk - $6,000.00/wk", "$1,500/mo", "Competitive pay and benefits", "$39,700 - $72,800/year", "$22.50 / hour", "DOE")
POSTED = ("2024-05-0{}T08:00:00+00:00", "2024-05-0{}", "", "2024-06-0{}T12:30:00+00:00")
AGES = ("{}d", "2024-12-2{}", "soon", "1{}d", "2024-13-4{}", " {} D ")
AGO = ("Posted Today", "Posted Yesterday", "Posted 3 Days Ago", "Posted 30+ Days Ago", "Recently", "")
TIERS = ("APPLY", "APPLY_CAVEAT", "INELIGIBLE", "PENDING", "APPLY")
STATUSES = ("new", "new", "saved", "dismissed", "new", "applied")

#: column: (choices, index expression over k and c, filler expression)
_PICKED = {
    "title": (TITLES, "k * 7 + c", None),
    "location": (LOCATIONS, "k * 5 + c", None),
    "description": (TEXTS, "k * 11 + c * 3", None),
    "url": (URLS, "k * 3 + c", "10000000 + (k * 13 + c) % 7001"),
    "salary": (SALARIES, "k * 13 + c", None),
    "posted_at": (POSTED, "k + c", "1 + k % 8"),
    "age": (AGES, "k * 3 + c", "k % 10"),
    "posted_on": (AGO, "k + c * 5", None),
    "tier": (TIERS, "k * 17 + c", None),
    "status": (STATUSES, "k * 19 + c", None),
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class Dialect:
    """How an engine writes a pick from a list and a substitution."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, value: str) -> str:
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"' if self.spark else _text(value)

    def pick(self, choices: tuple[str, ...], index: str) -> str:
        items, at = ", ".join(map(self.text, choices)), f"CAST(({index}) % {len(choices)} + 1 AS INT)"
        return f"element_at(array({items}), {at})" if self.spark else f"list_extract([{items}], {at})"

    def fill(self, template: str, value: str) -> str:
        return f"replace({template}, '{{}}', {value})"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def epoch(self, column: str) -> str:
        return f"unix_timestamp(CAST({column} AS TIMESTAMP))" if self.spark else f"CAST(epoch({column}) AS BIGINT)"


def select_list(dialect: Dialect) -> str:
    """The projection of rows (k, c, day) to postings."""
    d = dialect
    name = f"concat({d.pick(FIRST, 'c')}, {d.pick(SECOND, d.div('c', 20))})"
    columns = ["k AS seq", f"{d.fill(d.pick(FORMS, 'k'), name)} AS company"]
    for column, (choices, index, filler) in _PICKED.items():
        picked = d.pick(choices, index)
        columns.append(f"{d.fill(picked, f'CAST({filler} AS VARCHAR(20))') if filler else picked} AS {column}")
    columns.append(f"{d.epoch('day')} + k AS found_s")
    return ", ".join(columns)


_SOURCED = """seq, company, title, location, description, url, salary, posted_at, age, posted_on, tier, status, found_s, reason,
    CASE WHEN seq % 7 = 3 THEN NULL ELSE url END AS apply_url,
    seq % 5 = 1 AS is_easy_apply,
    CASE WHEN seq % 3 = 0 THEN {digits} WHEN seq % 3 = 1 THEN concat('gh:', {sha}) ELSE concat('ats:', {sha}) END AS id"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings from the orders of ``sf_dir``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = orders.selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderdate AS day")
    # Splits follow bytes and row groups, the work follows rows; the count comes from the files' footers.
    parts = max(spark.sparkContext.defaultParallelism, -(-keys.count() // TASK_ROWS))
    keys = keys.repartition(parts, "k")
    rows = keys.selectExpr(*_split(select_list(Dialect(True))), "'' AS reason")
    digits = "CAST(4000000000 + seq % 9973 AS STRING)"
    sourced = rows.selectExpr(*_split(_SOURCED.format(digits=digits, sha="left(sha1(url), 16)")))
    return sourced.withColumn("found_at", F.timestamp_seconds("found_s"))


def _split(columns: str) -> list[str]:
    """Top-level commas of a projection."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(columns):
        ch = columns[i]
        if quote:
            if ch == "\\" and quote == '"':
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "," and depth == 0:
            out.append(columns[start:i].strip())
            start = i + 1
        i += 1
    return [*out, columns[start:].strip()]


def postings_sql() -> str:
    """The same rows as a common table expression ``postings`` in DuckDB's SQL."""
    digits = "CAST(4000000000 + seq % 9973 AS VARCHAR)"
    return (
        "picked AS (SELECT " + select_list(Dialect(False)) + ", '' AS reason FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS day FROM orders)), "
        "postings AS (SELECT " + _SOURCED.format(digits=digits, sha="left(sha1(url), 16)") + " FROM picked)"
    )


#: Made-up forms: labels, a profile, answers, options and the keys that answers are looked up by.
FORM_LABELS = (
    "Preferred First Name", "Legal first name", "First name", "Middle name", "Surname", "E-mail", "Mobile phone number", "Address line 1", "Address line 2", "City",
    "State / Province", "Postal code", "Do you reside in the United States?", "Country", "LinkedIn URL", "What best describes your level of experience with GitHub?",
    "GitHub profile", "Personal website", "University", "Degree", "Field of study", "When do you graduate?", "Will you need sponsorship?", "Are you a U.S. citizen?",
    "Desired salary", "Available start date", "Are you willing to relocate?", "Gender", "Veteran status", "Why us?", "  ", "-- Select --", "Please choose an option", "Selected Employer", "N/A",
)
PROFILE = {
    "first_name": "Al", "last_name": "Reed", "email": "al@example.org", "phone": "555 0100", "address_street": "1 Main St", "address_city": "Austin", "address_zip": "78701",
    "resides_in_us": "Yes", "linkedin_url": "https://example.org/al", "school": "Example University", "degree": "BSc", "requires_sponsorship": "No", "willing_to_relocate": "Yes",
}
OPTIONS = ("Yes, I am willing to relocate.", "No", "Extensive Experience. I need little help.", "Limited Experience. I need help.", "Canada", "United States", "United States Minor Outlying Islands", "Other. First kind", "Other. Second kind")
ANSWERS = ("yes", " NO ", "extensive  experience", "Limited experience.", "United States", "United", "other", "no, i do not have one", "not sure")
ANSWER_KEYS = ("no", "not", "yes", "united states", "no, i do")
SIGNS = ("", "\U0001f525 ", "(", "  - ", "\u014c", "\U0001f525")
