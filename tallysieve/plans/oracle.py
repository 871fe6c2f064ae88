"""The registered queries in DuckDB's SQL, written apart from the DataFrame code.

Word lists and patterns are shared constants; lookahead, which this dialect lacks,
is written out as an alternative.
"""

from __future__ import annotations

from tallysieve import synth
from tallysieve.functions import forms, locations, salary, text, titles
from tallysieve.operators import gates, verdicts
from tallysieve.operators import views as reader

SQL: dict[str, str] = {}


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def sub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def first(c: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({c}, {q(pattern)}, {group}), '')"


def every(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({c}, {q(pattern)}, {group})"


def filled(c: str) -> str:
    return f"coalesce({c}, '')"


def kept(c: str, condition: str) -> str:
    return f"list_filter({c}, lambda w: {condition})"


def distinct(c: str) -> str:
    """Distinct items in order of first occurrence."""
    return f"list_filter({c}, lambda w, i: list_position({c}, w) = i)"


def define(name: str, select: str, *tables: str) -> None:
    SQL[name] = "WITH " + ", ".join([synth.postings_sql(), *tables]) + " " + select


def company_key(c: str) -> str:
    t = sub(sub(f"lower(trim({filled(c)}))", r"\(yc.*?\)"), r"'s\b")
    w = kept(f"string_split({sub(t, '[^a-z0-9 ]', ' ')}, ' ')", "w <> ''")
    w = f"CASE WHEN ({w})[1] = 'the' THEN ({w})[2:] ELSE {w} END"
    told = kept(f"({w})", f"w NOT IN {words(text.COMPANY_NOISE)}")
    return f"array_to_string(CASE WHEN len({told}) > 0 THEN {told} ELSE ({w}) END, ' ')"


def role_key(c: str) -> str:
    t = sub(sub(f"lower(trim({filled(c)}))", "[^a-z0-9 ]", " "), r"\b(internship|intern|co\s*op|coop)\b")
    return f"trim({sub(t, r'\s+', ' ')})"


KEYED = f"keyed AS (SELECT *, concat({company_key('company')}, '|', {role_key('title')}) AS norm_key FROM postings)"


def phrases(c: str, values: tuple[str, ...]) -> str:
    return has(f"lower({filled(c)})", r"\b(?:" + "|".join(values) + r")\b")


_INTERN = gates.INTERN.replace("(?![a-z0-9])", "([^a-z0-9]|$)")
INTERNSHIP = (
    f"({has('lower(title)', _INTERN)} OR (NOT {has('lower(title)', gates.STUDENT_OFFICE)} AND {has('lower(title)', gates.STUDENT)} AND {has('lower(title)', gates.SOFTWARE)}))"
)
GATE = f"CASE WHEN source = 'list' THEN NULL WHEN {phrases('title', gates.SENIOR)} THEN 'Senior-level title' WHEN {phrases('title', gates.NEW_GRAD)} THEN 'New-graduate role' WHEN NOT {INTERNSHIP} THEN 'No internship marker in title' END"
SOURCE = "CASE WHEN starts_with(id, 'gh:') THEN 'list' WHEN starts_with(id, 'ats:') THEN 'board' ELSE 'search' END"

define(
    "actionable_counts",
    "SELECT source, count(*) AS total, count_if(gate IS NULL) AS passed, count_if(gate IS NULL AND tier IN ('APPLY', 'APPLY_CAVEAT')) AS actionable FROM judged GROUP BY source",
    KEYED,
    "fresh AS (SELECT * FROM keyed WHERE seq % 4 <> 0 AND id NOT IN (SELECT id FROM keyed WHERE seq % 4 = 0) AND norm_key NOT IN (SELECT norm_key FROM keyed WHERE seq % 4 = 0))",
    f"firsts AS (SELECT *, {SOURCE} AS source FROM fresh QUALIFY row_number() OVER (PARTITION BY norm_key ORDER BY seq) = 1)",
    f"judged AS (SELECT *, {GATE} AS gate FROM firsts)",
)
define("norm_company", f"SELECT company, {company_key('company')} AS norm_company, n FROM (SELECT company, count(*) AS n FROM postings GROUP BY company)")
define("norm_role", f"SELECT title, {role_key('title')} AS norm_role, n FROM (SELECT title, count(*) AS n FROM postings GROUP BY title)")
define(
    "norm_key_stale",
    "SELECT seq, stored_key, norm_key FROM (SELECT seq, norm_key, CASE WHEN seq % 10 = 0 THEN NULL WHEN seq % 10 = 1 THEN norm_key || ' old' ELSE norm_key END AS stored_key FROM keyed) WHERE stored_key IS DISTINCT FROM norm_key",
    KEYED,
)
define(
    "title_gates",
    f"SELECT title, source, n, {phrases('title', gates.SENIOR)} AS senior, {phrases('title', gates.NEW_GRAD)} AS new_grad, {INTERNSHIP} AS internship, {GATE} AS gate_reason FROM (SELECT title, {SOURCE} AS source, count(*) AS n FROM postings GROUP BY ALL)",
)
define(
    "tenant_gates",
    f"SELECT title, n, CASE WHEN {phrases('title', gates.SENIOR_HOURLY)} THEN 'Senior-level title' WHEN {has('lower(title)', gates.INTERN_OR_STUDENT)} THEN 'Internship or student role' END AS hourly, "
    f"CASE WHEN {phrases('title', gates.SENIOR_LOCAL)} THEN 'Senior-level title' WHEN {phrases('title', gates.NEW_GRAD)} THEN 'New-graduate role' WHEN {has('title', gates.EXPERIENCED)} THEN 'Experienced level' END AS local "
    "FROM (SELECT title, count(*) AS n FROM postings GROUP BY title)",
)
define("dedup_dual_key", "SELECT seq, id, norm_key FROM keyed k WHERE seq % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM keyed s WHERE s.seq % 4 = 0 AND s.id = k.id) AND NOT EXISTS (SELECT 1 FROM keyed s WHERE s.seq % 4 = 0 AND s.norm_key = k.norm_key)", KEYED)
define(
    "candidate_dedup",
    "SELECT id, min(how) AS matched_by FROM (SELECT b.id, 'id' AS how FROM keyed b WHERE b.seq % 4 <> 0 AND b.id IN (SELECT id FROM keyed WHERE seq % 4 = 0) UNION ALL SELECT b.id, 'norm_key' FROM keyed b WHERE b.seq % 4 <> 0 AND b.norm_key IN (SELECT norm_key FROM keyed WHERE seq % 4 = 0)) GROUP BY id",
    KEYED,
)
define("dedup_first_per_key", "SELECT min(seq) AS seq, norm_key FROM keyed GROUP BY norm_key", KEYED)
define(
    "insert_ignore",
    "SELECT seq, id, norm_key, tier FROM keyed WHERE seq % 4 = 0 UNION ALL SELECT seq, id, norm_key, tier FROM (SELECT * FROM keyed WHERE seq % 4 <> 0 AND id NOT IN (SELECT id FROM keyed WHERE seq % 4 = 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)",
    KEYED,
)
define(
    "view_counts",
    "SELECT count_if(tier = 'APPLY' AND status = 'new') AS to_apply, count_if(tier = 'APPLY_CAVEAT' AND status = 'new') AS caveat, count_if(tier IN ('APPLY', 'APPLY_CAVEAT') AND status = 'new') AS my_list, count_if(status = 'applied') AS applied, count_if(status = 'saved') AS saved, count_if(status = 'dismissed') AS dismissed FROM postings",
)
define(
    "view_filters",
    f"SELECT seq, id, title FROM postings WHERE tier IN ('APPLY', 'APPLY_CAVEAT') AND status = 'new' AND {has('title', reader.INTERN_TITLE)} AND NOT starts_with(id, 'ats:') AND found_s >= 904694400 - 720 * 3600 AND (contains(lower(company), 'line') OR contains(lower(title), 'line'))",
)
define("actionable_rows", "SELECT seq, tier, status FROM postings WHERE status <> 'new' OR tier IN ('APPLY', 'APPLY_CAVEAT')")
define("optional_columns", "SELECT bool_or(starts_with(id, 'ats:')) AS source, false AS resume, bool_or(salary <> '') AS salary FROM postings")
define("freshest_first_topk", "SELECT seq, posted_at FROM postings ORDER BY posted_at DESC, seq LIMIT 100")
define("table_sort_topk", "SELECT seq, company FROM postings ORDER BY lower(strip_accents(company)), seq LIMIT 50")
define("pending_queue_topk", "SELECT seq, id, found_s FROM postings WHERE tier = 'PENDING' ORDER BY found_s, id LIMIT 40")
define(
    "queue_drain",
    "SELECT seq, outcome FROM stops WHERE coalesce(sum(stop) OVER (ORDER BY found_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0".replace("SELECT seq, outcome FROM stops WHERE coalesce(", "SELECT seq, outcome FROM stops QUALIFY coalesce("),
    "queue AS (SELECT seq, id, found_s, CASE WHEN seq % 11 = 0 THEN 'billing' WHEN seq % 5 = 0 THEN 'transient' WHEN seq % 7 = 0 THEN 'poison' ELSE 'ok' END AS outcome FROM postings WHERE tier = 'PENDING' ORDER BY found_s, id LIMIT 40)",
    "runs AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (ORDER BY found_s, id) AS run FROM queue)",
    "stops AS (SELECT *, CASE WHEN outcome = 'billing' OR sum(CASE WHEN outcome = 'transient' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY found_s, id) >= 2 THEN 1 ELSE 0 END AS stop FROM runs)",
)
_PAY = [first("description", f"(?i){p}") for p in salary.ANCHORED] + [
    f"CASE WHEN NOT {has(f"right(regexp_extract(description, {q(f'(?is)^(.*?){p}')}, 1), 40)", salary.OTHER_MONEY)} THEN {first('description', f'(?i){p}')} END" for p in salary.UNANCHORED
]
PAY = f"trim(coalesce({', '.join(_PAY)}))"
define("salary_extract", f"SELECT md5(description) AS text_md5, {PAY} AS salary, n FROM (SELECT description, count(*) AS n FROM postings GROUP BY description)")
define(
    "salary_compact",
    """SELECT salary, CASE WHEN len(v) = 0 THEN CASE WHEN length(salary) > 12 THEN left(salary, 11) || '…' ELSE salary END
    WHEN v[2] IS NOT NULL AND v[2] <> v[1] THEN concat('$', CASE WHEN v[1] >= 1000 AND v[2] >= 1000 THEN r(v[1] / 1000) WHEN v[1] >= 1000 THEN r(v[1] / 1000) || 'k' ELSE r(v[1]) END, '–', CASE WHEN v[2] >= 1000 THEN r(v[2] / 1000) || 'k' ELSE r(v[2]) END, u)
    ELSE concat('$', CASE WHEN v[1] >= 1000 THEN r(v[1] / 1000) || 'k' ELSE r(v[1]) END, u) END AS compact, n FROM units""".replace("r(v[1] / 1000)", "CAST(CAST(floor(v[1] / 1000 + 0.5) AS BIGINT) AS VARCHAR)")
    .replace("r(v[2] / 1000)", "CAST(CAST(floor(v[2] / 1000 + 0.5) AS BIGINT) AS VARCHAR)")
    .replace("r(v[1])", "CAST(CAST(floor(v[1] + 0.5) AS BIGINT) AS VARCHAR)")
    .replace("r(v[2])", "CAST(CAST(floor(v[2] + 0.5) AS BIGINT) AS VARCHAR)"),
    "units AS (SELECT salary, count(*) AS n, list_transform(regexp_extract_all(salary, '\\$\\s*([\\d,]+(?:\\.\\d+)?)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS v, "
    "CASE left(lower(regexp_extract(salary, '(?i)/?\\s*(hr|hour|wk|week|mo|month|yr|year)', 1)), 1) WHEN 'h' THEN '/hr' WHEN 'w' THEN '/wk' WHEN 'm' THEN '/mo' WHEN 'y' THEN '/yr' ELSE '' END AS u FROM postings GROUP BY salary)",
)
define(
    "split_locations",
    "SELECT location, array_to_string(places, '|') AS places, CAST(len(places) AS BIGINT) AS n_places, count_only, n FROM joined",
    f"whole AS (SELECT location, count(*) AS n, {has('trim(location)', locations.COUNT_ONLY)} AS count_only, {sub(sub(sub('trim(location)', r'(?i)^\d+\s+locations?'), '([A-Z]{2})([A-Z][a-z])', '\\1~\\2'), '([a-z)])([A-Z][a-z])', '\\1~\\2')} AS t FROM postings GROUP BY location)",
    "parts AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '~|\\s*;\\s*'), lambda p: trim(p)), lambda p: p <> '') AS p FROM whole)",
    f"joined AS (SELECT location, n, count_only, CASE WHEN count_only THEN [trim(location)] WHEN len(p) = 0 THEN [] ELSE list_reduce(list_transform(p, lambda x: [x]), lambda acc, x: CASE WHEN {has('acc[-1]', locations.NAME_PREFIX)} THEN list_concat(acc[:-2], [acc[-1] || x[1]]) ELSE list_concat(acc, x) END) END AS places FROM parts)",
)
define(
    "full_time_override",
    f"SELECT md5(description) AS text_md5, {has('description', verdicts.FULL_TIME)} AND NOT {has('description', verdicts.INTERNSHIP_WORD)} AS full_time, {has('description', verdicts.GRADUATE_ONLY)} AND NOT {has('description', verdicts.UNDERGRADUATE)} AS graduate_only, n FROM (SELECT description, count(*) AS n FROM postings GROUP BY description)",
)
_BOTH = "(title || chr(10) || description)"
_SCHOOLS = [p.replace(r"(?=\s*$|\s*[|,–—-])", r"\b") for p in verdicts.SCHOOL_RULES]
SCHOOL = f"trim(coalesce({', '.join(first(_BOTH, p, 1) for p in _SCHOOLS)}))"
OTHER_SCHOOL = f"CASE WHEN {SCHOOL} <> 'Example State University' THEN {SCHOOL} END"
define("school_override", f"SELECT school, count(*)::HUGEINT::BIGINT AS n FROM (SELECT {OTHER_SCHOOL} AS school FROM postings) WHERE school IS NOT NULL GROUP BY school")
PLACE = f"CASE WHEN NOT {has('location', verdicts.HOME_STATE)} AND NOT {has('location', verdicts.HOME_WORD)} THEN {first('location', verdicts.FOREIGN)} END"
define("non_us_override", f"SELECT location, {PLACE} AS place, n FROM (SELECT location, count(*) AS n FROM postings GROUP BY location)")


def flat(c: str) -> str:
    return f"trim({sub(sub(c, text.BLOCK_MARKUP, ' . '), text.INLINE_MARKUP, ' ')})"


def guarded(pattern: str, condition: str) -> str:
    """The first match m[i] that holds the condition, which may use ``hit`` and ``before``."""
    m, p = every("body", pattern), f"regexp_split_to_array(body, {q(pattern)})"
    before = "right(array_to_string(list_transform(range(1, i + 1), lambda j: p[j] || CASE WHEN j < i THEN m[j] ELSE '' END), ''), 80)"
    return f"(SELECT list_transform(list_filter(range(1, len(m) + 1), lambda i: {condition.replace('hit', 'm[i]').replace('before', before)}), lambda i: m[i])[1] FROM (SELECT {m} AS m, {p} AS p))"


def _gate_cases() -> str:
    no_perk = f"NOT {has('before', verdicts.PERK)}"
    who = f"regexp_extract(hit, {q(verdicts.NAMED_GROUP)}, 1)"
    generic = f"len(list_filter(regexp_extract_all(lower({who}), '[a-z]+'), lambda w: w NOT IN {words(verdicts.GENERIC_GROUP)})) = 0"
    own = f"trim({who}) IN ('Example State', 'Example State University')"
    home = "|".join([verdicts.HOME_COUNTRY, r"Example\s+State", r"Example\s+City"])
    abroad = f"NOT {has(f'regexp_extract(hit, {q(verdicts.REGION)}, 1)', rf'(?i)\b(?:{home})\b')}"
    prior = first("body", verdicts.PRIOR_INTERNSHIP)
    named = f"regexp_extract(body, {q(verdicts.PRIOR_INTERNSHIP)}, 1)"
    three = lambda c: f"regexp_extract_all(lower({c}), '[a-z]{{3,}}')"
    rules = [(label, first("t", p)) for label, p in verdicts.TITLE_GATES]
    rules.append((verdicts.GROUP_LABELS["restricted"], first("body", verdicts.RESTRICTED)))
    rules.append((verdicts.GROUP_LABELS["interns"], guarded(verdicts.INTERNS_ONLY, no_perk)))
    rules.append((verdicts.GROUP_LABELS["named"], guarded(verdicts.NAMED_GROUP, f"NOT ({own}) AND NOT ({generic}) AND {no_perk}")))
    rules += [(label, first("body", p)) for label, p in verdicts.TEXT_GATES]
    rules.append((verdicts.GROUP_LABELS["prior"], f"CASE WHEN {has(f'lower({named})', '^(us|our)')} OR list_has_any({three(named)}, {three('company')}) THEN {prior} END"))
    rules.append((verdicts.GROUP_LABELS["veteran"], f"CASE WHEN {has('t', verdicts.VETERAN_TITLE)} THEN {first('body', verdicts.VETERAN_TEXT)} END"))
    rules.append((verdicts.GROUP_LABELS["military"], first("body", verdicts.MILITARY)))
    rules.append((verdicts.GROUP_LABELS["region"], guarded(verdicts.REGION, abroad)))
    parts = ", ".join(f"CASE WHEN ({quote}) IS NOT NULL THEN {{'label': {q(label)}, 'quote': ({quote})}} END" for label, quote in rules)
    return f"coalesce({parts})"


GATED = f"gated AS (SELECT *, {_gate_cases()} AS g FROM (SELECT *, {flat('title')} AS t, {flat("title || ' . ' || description")} AS body FROM distinct_rows))"
define("insider_gate", "SELECT g.label AS label, g.quote AS quote, CAST(sum(n) AS BIGINT) AS n FROM gated GROUP BY ALL", "distinct_rows AS (SELECT title, description, company, count(*) AS n FROM postings GROUP BY ALL)", GATED)

_FACTS = (
    "distinct_rows AS (SELECT DISTINCT title, description, company FROM postings)",
    GATED,
    "facts AS (SELECT p.*, g.g.label AS gate, g.g.quote AS quote, tier IN ('APPLY', 'APPLY_CAVEAT') AS open, "
    f"{has('p.description', verdicts.FULL_TIME)} AND NOT {has('p.description', verdicts.INTERNSHIP_WORD)} AS full_time, {OTHER_SCHOOL.replace('title', 'p.title').replace('description', 'p.description')} AS school, "
    f"{has('p.description', verdicts.GRADUATE_ONLY)} AND NOT {has('p.description', verdicts.UNDERGRADUATE)} AS degree, {PLACE} AS place, {PAY.replace('description', 'p.description')} AS pay FROM postings p JOIN gated g USING (title, description, company))",
    """whys AS (SELECT *, CASE WHEN NOT open THEN NULL
      WHEN gate IS NOT NULL THEN 'Overridden: this posting is restricted to a group the candidate is not in (' || gate || ') — "' || left(trim(quote), 160) || '".'
      WHEN full_time THEN 'Overridden: description explicitly states this is a full-time/permanent position, with no internship/co-op language anywhere in the posting.'
      WHEN school IS NOT NULL THEN 'Overridden: this co-op is restricted to students currently enrolled at ' || school || ', not Example State University.'
      WHEN degree THEN 'Overridden: description requires current enrollment in a graduate-level (MS/PhD) program, with no bachelor''s/undergraduate alternative mentioned — candidate is a BS student.'
      WHEN place IS NOT NULL THEN 'Overridden: this role is based in ' || upper(place[1]) || lower(place[2:]) || ' with no US or US-remote option stated; candidate is a US citizen without the right to work there.' END AS why,
      (gate IS NOT NULL AND tier <> 'PENDING') OR (open AND NOT full_time AND (school IS NOT NULL OR degree OR place IS NOT NULL)) AS hard FROM facts)""",
    "lifted AS (SELECT *, CASE WHEN starts_with(id, 'gh:') AND NOT hard AND (why IS NOT NULL OR tier = 'INELIGIBLE') THEN 'APPLY_CAVEAT' WHEN why IS NOT NULL THEN 'INELIGIBLE' ELSE tier END AS tier2 FROM whys)",
    "corrected AS (SELECT * EXCLUDE (tier, reason, salary), tier AS old_tier, CASE WHEN tier2 = 'APPLY' AND length(trim(description)) < 200 THEN 'APPLY_CAVEAT' ELSE tier2 END AS tier, "
    "CASE WHEN tier2 = 'APPLY' AND length(trim(description)) < 200 THEN 'Classified on title only — no description available' ELSE coalesce(why, reason) END AS reason, coalesce(nullif(salary, ''), pay) AS salary FROM lifted)",
)
define("override_chain", "SELECT tier, reason, hard AS hard_ineligible, count(*) AS n, count(salary) AS n_salary FROM corrected GROUP BY ALL", *_FACTS)
define("title_only_downgrade", "SELECT seq, tier FROM corrected WHERE old_tier = 'APPLY' AND starts_with(reason, 'Classified on title only')", *_FACTS)
define(
    "tier_transitions",
    "SELECT old_tier, tier AS new_tier, CASE WHEN r(tier) > r(old_tier) THEN 'promoted' WHEN r(tier) < r(old_tier) THEN 'demoted' ELSE 'level' END AS direction, count(*) AS n FROM corrected WHERE old_tier <> 'PENDING' AND tier <> old_tier GROUP BY ALL".replace(
        "r(tier)", "CASE tier WHEN 'INELIGIBLE' THEN 0 WHEN 'APPLY' THEN 2 ELSE 1 END"
    ).replace("r(old_tier)", "CASE old_tier WHEN 'INELIGIBLE' THEN 0 WHEN 'APPLY' THEN 2 ELSE 1 END"),
    *_FACTS,
)

_HREF = "href AS (SELECT seq, id, CASE WHEN is_easy_apply THEN url ELSE coalesce(apply_url, url) END AS h FROM postings)"


def target(source: str, row_id: str) -> tuple[str, ...]:
    """Tables that end in ``targets`` (all of ``source`` and its canonical key) from a column h."""
    url = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?"
    uuid = "[0-9a-f]{8}-[0-9a-f-]{27,}"
    noise = "|".join(p for p in ("ats", "fr", "gh_src", "lever-origin", "lever-source", "nl", "ref", "source", "src", "trackingid", "trk"))
    req = sub(sub(sub(f"lower({first('path', r'(?i)_((?:JR|R)[-_]?[A-Z0-9-]+)$', 1)})", "^jr-", "jr"), "^r-", "r"), r"^((?:jr|r)\d{4,})-\d+$", "\\1")
    return (
        f"cut AS (SELECT *, lower({first('h', url, 1)}) AS full_host, url_decode({f'regexp_extract(h, {q(url)}, 2)'}) AS full_path, {f'regexp_extract(h, {q(url)}, 3)'} AS query FROM {source})",
        f"bare AS (SELECT *, {sub('full_host', '^www[.]')} AS host, CASE WHEN {sub('full_path', '/+$')} = '' THEN '/' ELSE {sub('full_path', '/+$')} END AS path FROM cut)",
        f"params AS (SELECT *, list_sort(list_transform(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT {has('p', f'(?i)^({noise})(=|$)')} AND NOT {has('p', '(?i)^utm_')}), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)) AS ps FROM bare)",
        f"""targets AS (SELECT *, CASE WHEN full_host IS NULL THEN 'row:' || {row_id} ELSE coalesce(
          CASE WHEN ends_with(host, 'linkedin.com') THEN 'linkedin:' || {first('path', r'(?i)/jobs/view/(?:.*?-)?(\d{7,})(?:/|$)', 1)} END,
          CASE WHEN ends_with(host, '.myworkdayjobs.com') THEN 'workday:' || {sub("split_part(host, '.', 1)", '[^a-z0-9]')} || ':' || {req} END,
          CASE WHEN contains(host, 'greenhouse.io') THEN coalesce('greenhouse:' || lower({first('path', r'(?i)/([^/]+)/jobs/(\d+)', 1)}) || ':' || {first('path', r'(?i)/([^/]+)/jobs/(\d+)', 2)}, 'greenhouse:' || host || ':' || {first('query', '(?:^|&)gh_jid=([^&]+)', 1)}) END,
          CASE WHEN ends_with(host, 'lever.co') THEN 'lever:' || lower({first('path', f'(?i)/({uuid})(?:/apply)?$', 1)}) END,
          CASE WHEN ends_with(host, 'ashbyhq.com') THEN 'ashby:' || lower({first('path', f'(?i)^/([^/]+)/({uuid})$', 1)}) || ':' || lower({first('path', f'(?i)^/([^/]+)/({uuid})$', 2)}) END,
          CASE WHEN contains(host, 'jobvite.com') THEN 'jobvite:' || lower({first('path', '(?i)/job/([a-z0-9_-]+)', 1)}) END,
          CASE WHEN ends_with(host, 'smartrecruiters.com') THEN 'smartrecruiters:' || {first('path', '/([0-9]{10,})(?:/|$)', 1)} END,
          CASE WHEN contains(host, 'icims.com') THEN 'icims:' || split_part(host, '.', 1) || ':' || {first('path', r'(?i)/jobs/(\d+)(?:/|$)', 1)} END,
          'url:' || host || lower(path) || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END) END AS target FROM params)""",
    )


def short_url(c: str) -> str:
    full = f"CASE WHEN contains(trim({c}), '://') THEN trim({c}) ELSE 'https://' || trim({c}) END"
    host = sub(f"lower(regexp_extract({full}, '^[^:/?#]*://([^/?#]*)([^?#]*)', 1))", "^www[.]")
    return f"CASE WHEN coalesce(trim({c}), '') = '' THEN '' ELSE {host} || {sub(sub(f"regexp_extract({full}, '^[^:/?#]*://([^/?#]*)([^?#]*)', 2)", ';[^/]*$'), '/+$')} END"


define("canonical_target", "SELECT seq, target FROM targets", _HREF, *target("href", "id"))
SQL["page_urls"] = f"WITH {', '.join(target('(SELECT page_id, url AS h FROM pages)', 'CAST(page_id AS VARCHAR)'))} SELECT target, {short_url('h')} AS short, count(*) AS n, min(page_id) AS first_page FROM targets GROUP BY ALL"
define(
    "tracker_match",
    "SELECT method, already_applied, count(*) AS n, count(DISTINCT matched_id) AS n_matched FROM matched GROUP BY ALL",
    KEYED,
    f"urls AS (SELECT id, status, seq, k, {short_url('u')} AS u FROM (SELECT id, status, seq, 0 AS k, url AS u FROM keyed WHERE seq % 4 = 0 UNION ALL SELECT id, status, seq, 1, apply_url FROM keyed WHERE seq % 4 = 0))",
    "by_url AS (SELECT u, id, status FROM urls WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY u ORDER BY seq, k) = 1)",
    "by_key AS (SELECT norm_key, id, status FROM keyed WHERE seq % 4 = 0 QUALIFY row_number() OVER (PARTITION BY norm_key ORDER BY seq) = 1)",
    f"tracker AS (SELECT norm_key, {short_url('link')} AS u FROM (SELECT norm_key, CASE WHEN seq % 3 = 0 THEN {sub('url', '^https://')} || '/' WHEN seq % 3 = 1 THEN '' ELSE 'https://nowhere.example.net/x' END AS link FROM keyed))",
    "matched AS (SELECT coalesce(a.id, b.id) AS matched_id, CASE WHEN a.id IS NOT NULL THEN 'url' WHEN b.id IS NOT NULL THEN 'norm_key' END AS method, coalesce(CASE WHEN a.id IS NOT NULL THEN a.status ELSE b.status END = 'applied', false) AS already_applied FROM tracker t LEFT JOIN by_url a ON t.u = a.u LEFT JOIN by_key b ON t.norm_key = b.norm_key)",
)


def sorted_text(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct({c})), ',')"


_SPECS = ", ".join(f"CASE WHEN {has('title', f'(?i){p}')} THEN {q(name)} END" for name, p in titles.SPECIALIZATIONS)
define(
    "facet_conflict",
    f"SELECT title, {sorted_text(f"list_transform({every('lower(title)', r'\b(spring|summer|fall|autumn|winter)\b', 1)}, lambda s: CASE WHEN s = 'autumn' THEN 'fall' ELSE s END)")} AS seasons, "
    f"{sorted_text(every('title', r'\b(20\d\d)\b', 1))} AS years, {sorted_text(every('upper(title)', rf'\b({titles.STATES})\b', 1))} AS states, {sorted_text(f'list_filter([{_SPECS}], lambda x: x IS NOT NULL)')} AS specs, n FROM (SELECT title, count(*) AS n FROM postings GROUP BY title)",
)


def plain(c: str) -> str:
    return f"trim({sub(f"replace(lower(strip_accents({c})), '&', ' and ')", '[^a-z0-9]+', ' ')})"


def plain_words(c: str) -> str:
    one = "CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"
    return f"list_transform(list_filter(string_split({plain(c)}, ' '), lambda w: w <> ''), lambda w: {one})"


def name_words(c: str) -> str:
    w = plain_words(sub(sub(c, r"(?i)\(yc.*?\)"), r"(?i)'s\b"))
    told = kept(w, f"w NOT IN {words(titles.COMPANY_NOISE)}")
    return f"CASE WHEN len({told}) > 0 THEN {distinct(told)} ELSE {distinct(w)} END"


_WORDED = (
    f"worded AS (SELECT *, {name_words('company')} AS cw, {plain_words('title')} AS tw, {plain_words('location')} AS lw FROM postings)",
    f"titled AS (SELECT *, list_distinct(list_transform(list_filter(tw, lambda w: w NOT IN {words(titles.TITLE_NOISE + titles.SEASONS)} AND NOT regexp_matches(w, '^20\\d\\d$') AND NOT list_contains(cw, w) AND NOT list_contains(lw, w)), lambda w: CASE WHEN w = 'engineering' THEN 'engineer' ELSE w END)) AS w FROM worded)",
)


def containment(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0 END"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0 END"


define("set_similarity", f"SELECT x.seq, round(CAST({containment('x.w', 'y.w')} AS DOUBLE), 6) AS containment, round(CAST({jaccard('x.w', 'y.w')} AS DOUBLE), 6) AS jaccard FROM titled x JOIN titled y ON y.seq = x.seq + 1", *_WORDED)
_BUCKETS = (
    "buckets AS (SELECT DISTINCT seq, unnest(list_concat(['full:' || array_to_string(cw, ' ')], list_transform(list_filter(cw, lambda w: length(w) >= 3), lambda w: 'word:' || w))) AS bucket FROM worded)",
    "sized AS (SELECT bucket FROM buckets GROUP BY bucket HAVING count(*) BETWEEN 2 AND {most})",
    "pairs AS (SELECT DISTINCT x.seq AS a, y.seq AS b FROM buckets x JOIN sized USING (bucket) JOIN buckets y USING (bucket) WHERE x.seq < y.seq)",
)
define("blocked_pairs", "SELECT a, b FROM pairs", *_WORDED, *(t.format(most=60) for t in _BUCKETS))


def _place(c: str) -> str:
    p = plain(c)
    return f"CASE WHEN {p} IN ('new york city ny', 'nyc') THEN 'new york ny' WHEN {p} = 'la' THEN 'los angeles ca' ELSE {p} END"


_PLACES = f"list_distinct(list_filter(list_concat(list_transform({every('location', r"([A-Za-z][A-Za-z .'-]*?,\s*[A-Z]{2})\b", 1)}, lambda x: {_place('x')}), list_transform(regexp_split_to_array(location, '\\s*[·;]\\s*'), lambda x: {_place("regexp_replace(x, '\\+\\d+\\s*$', '')")})), lambda x: x <> ''))"
_STRONG = lambda c: kept(c, f"w IN {words(titles.STRONG)}")
_MATCHING = (
    _HREF,
    *target("href", "id"),
    f"features AS (SELECT t.seq, t.status, t.found_s, t.id, g.target, t.cw, t.w, list_concat({plain_words('t.company')}, {plain_words("concat_ws(' ', g.full_host, CASE WHEN g.full_host IS NOT NULL THEN g.full_path END)")}) AS cc, array_to_string({plain_words("concat_ws(' ', g.full_host, CASE WHEN g.full_host IS NOT NULL THEN g.full_path END)")}, ' ') AS corpus, "
    f"{_PLACES.replace('location', 't.location')} AS places, list_distinct(list_transform({every('lower(t.title)', r'\b(spring|summer|fall|autumn|winter)\b', 1)}, lambda s: CASE WHEN s = 'autumn' THEN 'fall' ELSE s END)) AS seasons, list_distinct({every('t.title', r'\b(20\d\d)\b', 1)}) AS years, list_distinct({every('upper(t.title)', rf'\b({titles.STATES})\b', 1)}) AS states, "
    f"list_filter([{_SPECS.replace('(title', '(t.title')}], lambda x: x IS NOT NULL) AS specs, coalesce(ends_with(g.full_host, 'linkedin.com'), false) AS search FROM titled t JOIN targets g USING (seq))",
)


def _clash(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}))"


MATCH = (
    f"len(x.cw) > 0 AND len(y.cw) > 0 AND ({containment('x.cw', 'y.cw')} = 1 OR list_has_all(y.cc, x.cw) OR list_has_all(x.cc, y.cw)) "
    "AND len(x.places) > 0 AND len(y.places) > 0 AND (list_has_any(x.places, y.places) OR len(list_filter(x.places, lambda p: contains(y.corpus, p))) > 0 OR len(list_filter(y.places, lambda p: contains(x.corpus, p))) > 0) "
    f"AND NOT {_clash('x.seasons', 'y.seasons')} AND NOT {_clash('x.years', 'y.years')} AND NOT {_clash('x.states', 'y.states')} AND NOT {_clash('x.specs', 'y.specs')} AND NOT {_clash(_STRONG('x.specs'), _STRONG('y.specs'))} "
    f"AND len(x.w) > 0 AND len(y.w) > 0 AND ((len(x.w) = len(y.w) AND {containment('x.w', 'y.w')} = 1) OR (x.search <> y.search AND {containment('x.w', 'y.w')} >= 0.8 AND {jaccard('x.w', 'y.w')} >= 0.55))"
)
define("matched_pairs", f"SELECT a, b FROM pairs JOIN features x ON x.seq = a JOIN features y ON y.seq = b WHERE {MATCH}", *_WORDED, *(t.format(most=60) for t in _BUCKETS), *_MATCHING)
_RANK = "CASE {} WHEN 'applied' THEN 3 WHEN 'dismissed' THEN 2 WHEN 'saved' THEN 1 ELSE 0 END"
_OF_RANK = "list_extract(['new', 'saved', 'dismissed', 'applied'], CAST({} AS INT) + 1)"
# Reachability by repeated label passing: each round takes the smallest label next to a row, then its label's label.
_ROUNDS = 8


def _labels() -> tuple[str, ...]:
    out = ["l0 AS (SELECT rn, rn AS root FROM ranked)"]
    for k in range(1, _ROUNDS + 1):
        out.append(f"m{k} AS (SELECT l.rn, least(l.root, coalesce(min(o.root), l.root)) AS root FROM l{k - 1} l LEFT JOIN both_ways e ON e.a = l.rn LEFT JOIN l{k - 1} o ON o.rn = e.b GROUP BY l.rn, l.root)")
        out.append(f"l{k} AS (SELECT m.rn, least(m.root, o.root) AS root FROM m{k} m JOIN m{k} o ON o.rn = m.root)")
    return tuple(out)


define(
    "duplicate_groups",
    f"SELECT min_by(seq, rn) AS first_seq, count(*) AS size, {_OF_RANK.format('max(' + _RANK.format('status') + ')')} AS status FROM l{_ROUNDS} JOIN ranked USING (rn) GROUP BY root",
    *_WORDED,
    *(t.format(most=60) for t in _BUCKETS),
    *_MATCHING,
    "ranked AS (SELECT *, row_number() OVER (ORDER BY found_s DESC, id) - 1 AS rn FROM features)",
    "firsts AS (SELECT rn, target, seq, min(rn) OVER (PARTITION BY target) AS f FROM ranked)",
    f"edges AS (SELECT f AS a, rn AS b FROM firsts WHERE rn <> f AND NOT starts_with(target, 'url:') UNION SELECT o.f, o.rn FROM firsts o JOIN ranked x ON x.rn = o.f JOIN ranked y ON y.rn = o.rn WHERE o.rn <> o.f AND starts_with(o.target, 'url:') AND {MATCH} "
    f"UNION SELECT x.rn, y.rn FROM pairs JOIN ranked x ON x.seq = a JOIN ranked y ON y.seq = b WHERE {MATCH})",
    "both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)",
    *_labels(),
)

_MEMBERS = "members AS (SELECT seq - seq % 3 AS rn, 'p' || seq AS id, status FROM postings)"
_CHANGES = "changes AS (SELECT seq + 1 AS mutation_id, unnest(['p' || seq, 'p' || (seq + 1)]) AS id, list_extract(['saved', 'dismissed', 'applied'], CAST(seq % 3 + 1 AS INT)) AS desired, seq % 8 = 0 AS confirmed FROM postings WHERE seq % 4 = 0)"
define("group_status", f"SELECT rn, {_OF_RANK.format('max(' + _RANK.format('status') + ')')} AS status FROM members GROUP BY rn", _MEMBERS)
define("status_overlay", "SELECT m.rn, max_by(c.desired, c.mutation_id) AS status FROM members m LEFT JOIN changes c USING (id) GROUP BY m.rn", _MEMBERS, _CHANGES)
define("mutation_ack", "SELECT mutation_id FROM changes LEFT JOIN members USING (id) WHERE confirmed GROUP BY mutation_id HAVING bool_and(coalesce(status = desired, false))", _MEMBERS, _CHANGES)
define(
    "update_classification",
    "SELECT seq, CASE WHEN new THEN 'INELIGIBLE' ELSE tier END AS tier, CASE WHEN new THEN 'again' ELSE reason END AS reason, CASE WHEN new THEN 'Data' ELSE 'General' END AS suggested_resume, CASE WHEN new AND seq % 2 <> 0 THEN '$1' ELSE salary END AS salary FROM (SELECT *, seq % 3 = 0 AND seq % 9 <> 0 AS new FROM postings)",
)
define(
    "run_statistics",
    "SELECT seq % 20 AS run_id, CAST(count(*) AS INT) AS total_raw, CAST(count_if(seq % 3 = 0) AS INT) AS new_jobs, CAST(count_if(seq % 3 = 0 AND tier IN ('APPLY', 'APPLY_CAVEAT')) AS INT) AS notified, CAST(count_if(seq % 50 = 0) AS INT) AS rate_limited FROM postings GROUP BY ALL",
)
define("parked_by_kind", "SELECT CASE WHEN seq % 3 = 0 AND seq % 2 = 0 THEN 'billing' WHEN seq % 3 = 1 THEN 'auth' ELSE 'transient' END AS kind, count(*) AS n FROM postings WHERE tier = 'PENDING' GROUP BY ALL")
define("digest_since", "SELECT seq, tier, coalesce(nullif(apply_url, ''), nullif(url, ''), '#') AS link, nullif(salary, '') AS salary FROM postings WHERE found_s >= 900000000 AND tier IN ('APPLY', 'APPLY_CAVEAT')")
define("delta_cursor", "SELECT seq, id, found_s FROM postings WHERE NOT starts_with(id, 'gh:') AND NOT starts_with(id, 'ats:') AND tier IN ('APPLY', 'APPLY_CAVEAT') AND found_s > 850000000 ORDER BY found_s, id LIMIT 100")
define("epoch_normalise", "SELECT seq, CASE WHEN seq % 4 IN (0, 1) THEN found_s END AS posted_s FROM postings")


def ago(seconds: str) -> str:
    m = f"greatest(CAST(floor(({seconds}) / 60 + 0.5) AS BIGINT), 0)"
    h, d = f"CAST(floor({m} / 60 + 0.5) AS BIGINT)", f"CAST(floor(CAST(floor({m} / 60 + 0.5) AS BIGINT) / 24 + 0.5) AS BIGINT)"
    return f"CASE WHEN {m} < 1 THEN 'just now' WHEN {m} < 60 THEN {m} || 'm ago' WHEN {h} < 24 THEN {h} || 'h ago' WHEN {d} < 30 THEN {d} || 'd ago' ELSE CAST(floor({d} / 30 + 0.5) AS BIGINT) || 'mo ago' END"


define(
    "relative_age",
    f"SELECT seq, coalesce(CAST({first('trim(age)', r'(?i)^(\d+)\s*d$', 1)} AS BIGINT), CASE WHEN {has('trim(age)', r'^\d{4}-\d{2}-\d{2}$')} AND try_cast(trim(age) AS DATE) IS NOT NULL THEN greatest(date_diff('day', try_cast(trim(age) AS DATE), DATE '2024-12-31'), 0) END) AS age_days, "
    f"CASE WHEN contains(lower(posted_on), 'today') THEN 0 WHEN contains(lower(posted_on), 'yesterday') THEN 1 ELSE CAST({first('lower(posted_on)', r'(\d+)\+?\s+days?\s+ago', 1)} AS BIGINT) END AS posted_days, {ago(f'{synth.NOW_S} - found_s')} AS ago, {ago('(seq * 977) % 90000')} AS ago_short FROM postings",
)
define(
    "carry_forward_company",
    "SELECT tbl, pos, coalesce(last_value(nullif(nullif(raw, '↳'), '') IGNORE NULLS) OVER (PARTITION BY tbl ORDER BY pos), raw) AS company FROM (SELECT seq - seq % 25 AS tbl, seq AS pos, CASE WHEN seq % 3 = 1 THEN '↳' WHEN seq % 7 = 2 THEN '' ELSE company END AS raw FROM postings)",
)
define(
    "notification_text",
    f"SELECT id, {sub("company || ' - ' || title", '[^\\x00-\\x7F]', '?')} AS title_header, tier || CASE WHEN location <> '' THEN chr(10) || location ELSE '' END || chr(10) || 'Resume: General' AS body, CASE WHEN tier = 'APPLY' THEN 'high' ELSE 'default' END AS priority FROM postings WHERE tier IN ('APPLY', 'APPLY_CAVEAT')",
)
SQL["events_json_props"] = "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS n_k FROM events GROUP BY event_type"
SQL["event_windows"] = "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL"
SQL["stream_dedup"] = "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, CAST(sum(event_id) AS BIGINT) AS sum_ids FROM events GROUP BY event_type"
SQL["plain_names"] = f"SELECT doc_id, {plain('text')} AS plain FROM documents"
define(
    "board_listings",
    """SELECT 'ats:' || left(sha1(url), 16) AS id, title, company, CASE WHEN seq % 4 = 3 THEN concat_ws(', ', nullif(location, ''), 'us') ELSE location END AS location, url,
    CASE seq % 4 WHEN 0 THEN '2024-01-01' WHEN 1 THEN strftime(make_timestamp(found_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN '2024-01-02' ELSE '2024-01-03' END AS posted_at,
    CASE WHEN seq % 4 <> 3 THEN CAST(length(description) AS INT) END AS n_description FROM postings""",
)
define(
    "maintenance_log",
    f"""SELECT job, field, count(*) AS n FROM (
    SELECT 'norm_keys' AS job, 'norm_key' AS field FROM keyed WHERE seq % 10 = 0
    UNION ALL SELECT 'salaries', 'salary' FROM corrected WHERE pay IS NOT NULL AND seq IN (SELECT seq FROM postings WHERE salary = '')
    UNION ALL SELECT 'recheck', 'tier' FROM corrected WHERE status = 'new' AND old_tier IN ('APPLY', 'APPLY_CAVEAT') AND tier <> old_tier
    UNION ALL SELECT 'titles', 'tier' FROM postings WHERE status = 'new' AND tier IN ('APPLY', 'APPLY_CAVEAT') AND NOT starts_with(id, 'gh:') AND NOT {INTERNSHIP}
    UNION ALL SELECT 'lists', 'tier' FROM postings WHERE status = 'new' AND tier = 'INELIGIBLE' AND starts_with(id, 'gh:')) GROUP BY ALL""",
    KEYED,
    *_FACTS,
)


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def picked(values: tuple[str, ...], index: str = "seq") -> str:
    return f"({listed(values)})[CAST({index} % {len(values)} + 1 AS INT)]"


def fold(c: str) -> str:
    return f"lower(trim({sub(c, r'\s+', ' ')}))"


_LABEL = "trim(label)"
_ASKED = f"CASE WHEN {_LABEL} = '' OR {has(_LABEL, '(?i)' + forms.UNROUTED)} THEN NULL " + " ".join(f"WHEN {has(_LABEL, '(?i)' + p)} THEN {q(field)}" for p, field in forms.FIELD_RULES) + " END"
_VALUE = "CASE asked " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in synth.PROFILE.items()) + " END"
define(
    "form_routing",
    f"SELECT label, asked, {_VALUE} AS value, {has(fold('label'), '(?i)' + forms.UNCHOSEN)} AS unchosen, n FROM asked",
    f"labels AS (SELECT {picked(synth.FORM_LABELS)} AS label, count(*) AS n FROM postings GROUP BY ALL)",
    f"asked AS (SELECT *, {_ASKED} AS asked FROM labels)",
)
define(
    "form_options",
    f"SELECT form, value, CASE WHEN count(DISTINCT option) = 1 THEN min(option) END AS option, (SELECT max_by(k, length(k)) FROM (SELECT unnest({listed(synth.ANSWER_KEYS)}) AS k) WHERE starts_with({fold('value')}, k)) AS best "
    f"FROM wanted LEFT JOIN names ON {fold('value')} = name GROUP BY form, value",
    f"wanted AS (SELECT seq AS form, {picked(synth.ANSWERS)} AS value FROM postings)",
    f"options AS (SELECT option, {fold('option')} AS n FROM (SELECT unnest({listed(synth.OPTIONS)}) AS option))",
    "names AS (SELECT option, n AS name FROM options UNION SELECT option, trim(string_split(n, '.')[1]) FROM options UNION SELECT option, trim(string_split(n, '.')[1]) || '.' FROM options WHERE contains(n, '.') UNION SELECT option, trim(string_split(string_split(n, ',')[1], '.')[1]) FROM options)",
)
SQL["form_fields"] = """
    WITH v AS (SELECT *, event_id * 7919 % 997 AS a, event_id // 8 AS form, event_id % 8 AS pos, user_id % 2 = 0 AS radio FROM events),
    e AS (SELECT form, pos, radio, CASE WHEN radio OR a % 5 = 0 THEN event_type WHEN a % 5 = 1 THEN '37-' || pos || '-2' ELSE (a % 7) || '-' || pos END AS key FROM v),
    k AS (SELECT * FROM e WHERE NOT starts_with(key, '37-') AND NOT starts_with(key, '6-'))
    SELECT form, key, CAST(NULL AS VARCHAR) AS kind, pos AS first_pos, CAST(1 AS INT) AS n_members FROM k WHERE NOT radio
    UNION ALL SELECT form, key, 'radio', min(pos), CAST(count(*) AS INT) FROM k WHERE radio GROUP BY form, key"""
SQL["profile_fields"] = """
    SELECT *, CAST(3 + (c_custkey % 3 <> 2)::INT * 2 + (us_citizen IS NOT NULL)::INT + 1 AS INT) AS n_values,
    concat_ws('|', CASE WHEN c_custkey % 4 = 0 THEN 'personal.address.city' END, CASE WHEN c_custkey % 6 = 0 THEN 'skills[1]' END) AS gaps
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Alexis' ELSE 'Al' END AS first_name, c_name AS last_name, CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS resides_in_us,
    CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'Yes' ELSE 'No' END END AS us_citizen FROM customer)"""
define(
    "avatar_letters",
    f"SELECT company, upper(coalesce(nullif(left(trim({sub(sub('company', r'[\x{10000}-\x{10FFFF}]'), r'^[^A-Za-z0-9_À-￿]+')}), 1), ''), '?')) AS letter, n FROM named",
    f"named AS (SELECT {picked(synth.SIGNS)} || company AS company, count(*) AS n FROM postings WHERE company IS NOT NULL GROUP BY ALL)",
)
SQL["search_pages"] = """
    WITH v AS (SELECT *, event_id * 7919 % 997 AS a FROM events),
    p AS (SELECT event_id // 8 AS search, event_id % 8 AS page, a, CASE WHEN a % 11 = 0 THEN CASE WHEN a % 2 = 0 THEN 10 ELSE 0 END WHEN user_id % 7 = 0 THEN 6 ELSE 10 END AS n FROM v),
    j AS (SELECT *, CASE WHEN a % 50 = 0 THEN 'rate_limited' WHEN a % 50 = 1 THEN 'error' WHEN n = 0 THEN 'empty' WHEN CASE WHEN a % 9 = 0 THEN 10 ELSE 3 END >= n THEN 'known' WHEN n < 10 THEN 'short' END AS stopped FROM p)
    SELECT search, page, stopped FROM j WHERE NOT EXISTS (SELECT 1 FROM j AS b WHERE b.search = j.search AND b.page < j.page AND b.stopped IS NOT NULL)"""
_HOST = f"lower(regexp_extract(apply_url, {q('^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)')}, 1))"
_ROUTE = f"CASE WHEN {filled('apply_url')} = '' THEN NULL " + " ".join(f"WHEN contains({_HOST}, '{d}') THEN '{n}'" for d, n in (("greenhouse.io", "greenhouse"), ("lever.co", "lever"), ("ashbyhq.com", "ashby"), ("myworkdayjobs.com", "workday"), ("icims.com", "icims"))) + " ELSE 'generic' END"
_JOB = "'^[A-Za-z]+://([^/?#]+)/+(.*?)/job/([^?#]*?)/*(?:[?#]|$)'"
define(
    "detail_requests",
    f"""SELECT apply_url, route, coalesce(CASE route
    WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || {first('apply_url', r'greenhouse\.io/([^/]+)/jobs/(\d+)', 1)} || '/jobs/' || {first('apply_url', r'greenhouse\.io/([^/]+)/jobs/(\d+)', 2)}
    WHEN 'lever' THEN 'https://api.lever.co/v0/postings/' || {first('apply_url', r'lever\.co/([^/]+)/([0-9a-fA-F-]{36})', 1)} || '/' || {first('apply_url', r'lever\.co/([^/]+)/([0-9a-fA-F-]{36})', 2)}
    WHEN 'ashby' THEN 'https://api.ashbyhq.com/posting-api/job-board/' || {first('apply_url', r'ashbyhq\.com/([^/]+)/[0-9a-fA-F-]{36}', 1)}
    WHEN 'workday' THEN CASE WHEN site <> '' THEN concat_ws('|', base || site || '/job/' || path, base || {first('site', '^[a-zA-Z]{2}(?:-[a-zA-Z]{2})?/(.+)$', 1)} || '/job/' || path) END
    WHEN 'icims' THEN apply_url || CASE WHEN contains(apply_url, '?') THEN '&' ELSE '?' END || 'in_iframe=1'
    WHEN 'generic' THEN apply_url END, '') AS requests, n FROM (SELECT *, 'https://' || host || '/wday/cxs/' || string_split(host, '.')[1] || '/' AS base FROM routed)""",
    f"routed AS (SELECT apply_url, count(*) AS n, {_ROUTE} AS route, lower(regexp_extract(apply_url, {_JOB}, 1)) AS host, regexp_extract(apply_url, {_JOB}, 2) AS site, regexp_extract(apply_url, {_JOB}, 3) AS path FROM postings GROUP BY apply_url)",
)
define(
    "detail_text",
    "SELECT seq, ['greenhouse', 'lever', 'ashby', 'workday', 'icims'][CAST(seq % 5 + 1 AS INT)] AS route, CASE WHEN seq % 5 = 1 THEN nullif(left(description, 12000), '') WHEN seq % 5 < 4 THEN 'Role ' || seq WHEN seq % 2 = 0 THEN repeat('Role ' || seq, 60) END AS description FROM postings",
)


from tallysieve.plans import workflow_sql  # noqa: E402,F401,I001  defines its queries
from tallysieve.plans import live_sql  # noqa: E402,F401  defines its queries, one from those of the workflow
