"""The queries of ``workflow`` in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

from tallysieve import synth
from tallysieve.operators import gates, maintenance, process
from tallysieve.plans.oracle import _BUCKETS, _FACTS, _MATCHING, _OF_RANK, _RANK, _ROUNDS, _WORDED, MATCH, PAY, SQL, _labels, define, filled, has, phrases, q

_ID = "CASE WHEN seq % 3 = 1 THEN 'gh:' ELSE '' END || 'p' || seq"
_DAY = f"CAST(make_timestamp(CAST({synth.NOW_S} AS BIGINT) * 1000000) AS DATE)"
_VERDICT = "['APPLY', 'APPLY_CAVEAT', 'INELIGIBLE', 'APPLY'][CAST(seq % 4 + 1 AS INT)]"
_THIN = f"(length(trim({filled('d')})) < 200 OR {has(f'left({filled("d")}, 400)', maintenance.FURNITURE)})"

define(
    "search_cards",
    """SELECT CAST(seq + 1000000 AS VARCHAR) AS id, title, trim(company) AS company, trim(location) AS location, CASE WHEN seq % 9 = 0 THEN 'https://www.linkedin.com/jobs/view/' || (seq + 1000000) || '/' ELSE split_part(url, '?', 1) END AS url,
    '2024-05-01' AS posted_at, seq % 5 = 0 AS is_easy_apply FROM postings WHERE seq % 7 <> 3""",
)
define(
    "search_details",
    """SELECT CAST(seq AS VARCHAR) AS id, CASE WHEN seq % 4 = 0 THEN 'Level Intern' ELSE 'Role ' || seq || ' Learn' END AS description, CASE WHEN seq % 3 <> 0 THEN 'https://careers.example.com/' || seq END AS apply_url, seq % 3 = 0 AS is_easy_apply,
    CASE WHEN seq % 2 = 0 THEN '$' || format('{:,}', 20000 + seq) || '–$90,000 YEAR' WHEN seq % 5 = 0 THEN '$25–$35/hr' END AS salary FROM postings""",
)
define(
    "readme_listings",
    f"""SELECT 'gh:' || left(sha1('https://careers.example.com/' || seq), 16) AS id, 'Intern ' || seq AS title, company, 'Austin, TX' AS location, 'https://careers.example.com/' || seq AS url,
    CAST({_DAY} - CAST(seq % 10 AS INT) AS VARCHAR) AS posted_day, 'github:list' || tbl AS search_term FROM cells WHERE seq % 8 <> 5 AND seq % 10 <= 7""",
    "raw AS (SELECT seq, seq - seq % 25 AS tbl, CASE WHEN seq % 25 > 0 AND seq % 3 = 1 THEN NULL ELSE 'Company ' || seq END AS own FROM postings)",
    "cells AS (SELECT seq, tbl, CASE WHEN tbl % 2 = 0 THEN last_value(own IGNORE NULLS) OVER (PARTITION BY tbl ORDER BY seq) ELSE coalesce(own, '↳') END AS company FROM raw)",
)
define(
    "workday_listings",
    f"""SELECT 'ats:' || left(sha1(u), 16) AS id, title, 'Board ' || board AS company, location, u AS url, CASE WHEN days IS NOT NULL THEN CAST({_DAY} - days AS VARCHAR) END AS posted_day FROM (
    SELECT *, seq - seq % 50 AS board, 'https://acme' || (seq - seq % 50) || '.wd5.myworkdayjobs.com/careers/job/' || seq AS u,
    CASE WHEN contains(lower(posted_on), 'today') THEN 0 WHEN contains(lower(posted_on), 'yesterday') THEN 1 ELSE CAST(nullif(regexp_extract(lower(posted_on), '(\\d+)\\+?\\s+days?\\s+ago', 1), '') AS INT) END AS days FROM postings WHERE seq % 50 < 40 AND seq % 50 <> 25)""",
)
define("markup_text", "SELECT seq, 'Role' || chr(160) || seq || ' ' || title || ' <b>' AS text FROM postings")
define(
    "changed_lists",
    "SELECT 'list' || seq AS source_name, 'commit-' || (seq % 4) AS commit, 'acme' AS owner, 'list' || seq AS repository, 'dev' AS branch FROM postings WHERE seq % 6 <> 0 AND NOT (seq % 5 < 3 AND seq % 4 = seq % 3)",
)
SQL["first_pages"] = """SELECT stopped, count(*) AS n FROM (SELECT CASE WHEN a % 50 = 0 THEN 'rate_limited' WHEN a % 12 >= 10 THEN 'known' END AS stopped FROM (SELECT event_id * 7919 % 997 AS a FROM events WHERE event_id % 8 = 0)) GROUP BY stopped"""
define("set_status", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN seq IN (1, 2, 3) THEN 'applied' ELSE status END AS status FROM postings) GROUP BY status")
define("valid_id_lists", "SELECT seq, CASE seq % 5 WHEN 0 THEN 'gh:' || seq WHEN 4 THEN 'gh:' || seq || ',x_1' END AS ids FROM postings")
define("key_values", "SELECT 'k' || seq AS key, CASE WHEN seq = 3 THEN 'new' ELSE 'v' || seq END AS value FROM postings WHERE seq <> 4 UNION ALL SELECT 'other', 'added'")
define("parked_rows", "SELECT CASE WHEN seq % 6 = 0 THEN 'PENDING' WHEN seq % 4 = 0 OR tier = 'PENDING' THEN 'APPLY_CAVEAT' ELSE tier END AS tier, count(*) AS n FROM postings GROUP BY ALL")
define(
    "outage_alerts",
    "SELECT seq % 3 <> 2 AND (seq % 4 < 2 OR seq % 12 >= 6) AS alert, seq % 5 <> 0 AND seq % 2 = 1 AND seq % 4 <> 0 AS recovery, count(*) AS n FROM postings GROUP BY ALL",
)
define("run_lock", "SELECT s.source, (s.k = 1 OR count(p.seq) = 0) AS allowed FROM (VALUES ('search', 0), ('board', 1), ('list', 2)) s(source, k) LEFT JOIN postings p ON p.seq % 3 = s.k AND CASE WHEN s.k = 0 THEN p.seq % 60 ELSE 20 + p.seq % 60 END < 20 GROUP BY s.source, s.k")
define(
    "rolled_back_status",
    "SELECT id, status FROM (SELECT id, max(m) AS m, max_by(status, m) AS status FROM (SELECT unnest(['p' || seq, 'p' || (seq + 7)]) AS id, seq AS m, CASE WHEN seq % 2 = 0 THEN 'new' ELSE 'saved' END AS status FROM postings) GROUP BY id) WHERE m % 3 = 0",
)
define(
    "overlaid_groups",
    "SELECT seq AS rn, CASE WHEN seq % 4 = 0 THEN 'applied' ELSE status END AS status, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 4 = 0 THEN 'applied' ELSE status END END AS nested_status, true AS bare, CAST(13 AS BIGINT) AS n_view_columns FROM postings",
)
define(
    "grouped_rows",
    f"SELECT min_by(seq, rn) AS seq, count(*) - 1 AS n_others, {_OF_RANK.format('max(' + _RANK.format('status') + ')')} AS status, min_by(tier, rn) AS tier FROM l{_ROUNDS} JOIN ranked USING (rn) JOIN (SELECT seq, tier FROM postings) USING (seq) GROUP BY root",
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
define("full_timestamps", "SELECT seq, strftime(make_timestamp(found_s * 1000000), '%b %-d, %Y, %-I:%M %p') AS shown FROM postings")
define("empty_runs", "SELECT seq % 100 AS run_id FROM postings GROUP BY ALL HAVING sum(CASE WHEN seq % 4 = 0 THEN 0 ELSE seq % 5 END) = 0")
define("refetch_needed", f"SELECT seq, {_THIN} AS due FROM (SELECT seq, CASE seq % 5 WHEN 0 THEN 'Skip to main content. ' || description WHEN 1 THEN NULL ELSE description END AS d FROM postings)")


def _judged(condition: str) -> str:
    """The rules' tier of the rows under the verdict, where it differs from theirs."""
    return f"SELECT * FROM told WHERE seq % 7 <> 0 AND {condition} AND new_tier <> was"


def _told() -> tuple[str, ...]:
    """Tables that end in ``told``: postings under the made-up verdict after all rules, with their own tier as ``was``."""
    rules = [t.replace("FROM postings p", f"FROM (SELECT * EXCLUDE (id, tier, reason), {_ID} AS id, {_VERDICT} AS tier, 'told' AS reason FROM postings) p") for t in _FACTS]
    return (*rules, f"told AS (SELECT c.seq, c.tier AS new_tier, c.salary, p.tier AS was, p.status, {_ID.replace('seq', 'c.seq')} AS gid FROM corrected c JOIN postings p USING (seq))")


_GONE = "seq % 2 = 0"
_FOUND = "seq % 10 <> 4"
_KINDS = {"lists": "seq % 3 = 1", "actionable": "{t} IN ('APPLY', 'APPLY_CAVEAT')", "rejected": "{t} = 'INELIGIBLE' AND status = 'new' AND seq % 3 <> 1"}
define(
    "filled_descriptions",
    " UNION ALL ".join(
        f"SELECT 'fill_{kind}' AS job, 'description' AS field, NULL AS new, count(*) AS n FROM postings WHERE {_GONE} AND {_FOUND} AND {condition.format(t='tier')} HAVING count(*) > 0 "
        f"UNION ALL SELECT 'fill_{kind}', 'tier', new_tier, count(*) FROM ({_judged(_GONE + ' AND ' + _FOUND + ' AND ' + condition.format(t='was') + chr(32) + 'AND status = ' + q('new'))}) GROUP BY new_tier"
        for kind, condition in _KINDS.items()
    ),
    *_told(),
)
_OPEN = "{t} = 'APPLY' AND status NOT IN ('applied', 'dismissed')"
_ANY_VERDICT = "['APPLY', 'APPLY_CAVEAT', 'INELIGIBLE', 'APPLY_CAVEAT'][CAST(seq % 4 + 1 AS INT)]"
_SAID = "CASE WHEN seq % 4 = 1 THEN '$9/hr' END"
_RESUME = "CASE WHEN seq % 5 = 0 THEN 'General' ELSE 'Data' END"
_HELD = "(seq % 7 = 0 OR seq % 11 = 0)"


def _whole(pay: str) -> tuple[str, ...]:
    """Tables that end in ``whole``: postings under verdicts that say ``pay``, after all rules, with what they were before."""
    rules = [t.replace("FROM postings p", f"FROM (SELECT * EXCLUDE (id, tier, reason, salary), {_ID} AS id, {_ANY_VERDICT} AS tier, 'told ' || seq AS reason, {pay} AS salary FROM postings) p") for t in _FACTS]
    return (*rules, f"whole AS (SELECT c.seq, {_ID.replace('seq', 'c.seq')} AS gid, c.tier AS new_tier, c.reason AS new_reason, c.salary AS new_salary, p.tier AS was, p.salary AS had, p.status, p.title, p.description FROM corrected c JOIN postings p USING (seq))")


define(
    "refetched_rows",
    f"""SELECT 'refetch' AS job, gid AS id, 'description' AS field, description AS new FROM open_ WHERE d IS DISTINCT FROM description
    UNION ALL SELECT 'refetch', gid, field, new FROM (SELECT gid, unnest(['tier', 'reason', 'suggested_resume', 'salary']) AS field, unnest([was, '', 'General', had]) AS old, unnest([new_tier, new_reason, {_RESUME}, coalesce(nullif(new_salary, ''), had)]) AS new FROM open_ WHERE NOT {_HELD}) WHERE old IS DISTINCT FROM new""",
    *_whole(_SAID),
    f"open_ AS (SELECT * FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 'Sign in to see more' ELSE description END AS d FROM whole) WHERE {_OPEN.format(t='was')} AND {_THIN})",
)
define(
    "rejected_recheck",
    f"""SELECT 'rejected' AS job, gid AS id, field, new FROM (SELECT gid, unnest(['tier', 'reason', 'suggested_resume']) AS field, unnest([was, '', CASE WHEN seq % 5 = 0 THEN 'Data' ELSE 'General' END]) AS old, unnest([new_tier, new_reason, {_RESUME}]) AS new
      FROM whole WHERE was = 'INELIGIBLE' AND new_tier <> was AND NOT {_HELD}) WHERE old IS DISTINCT FROM new
    UNION ALL SELECT 'resumes', {_ID}, 'suggested_resume', 'Data' FROM postings WHERE status = 'new' AND tier IN ('APPLY', 'APPLY_CAVEAT') AND seq % 5 <> 0""",
    *_whole("salary"),
)
define(
    "fetched_facts",
    f"""SELECT field, count(*) AS n FROM (SELECT 'description' AS field FROM postings WHERE {_GONE} AND seq % 3 <> 0 UNION ALL SELECT 'apply_url' FROM postings WHERE apply_url IS NULL UNION ALL SELECT 'salary' FROM postings WHERE salary = '' AND seq % 5 = 0) GROUP BY field""",
)
define(
    "audit_rate",
    """SELECT n AS sampled, p AS promoted, n AS population, CASE WHEN n > 0 THEN CAST(floor(p / n * n) AS BIGINT) ELSE 0 END AS estimate FROM (
    SELECT count(*) AS n, count_if(seq % 4 < 2) AS p FROM postings WHERE status = 'new' AND tier = 'INELIGIBLE')""",
)
_FILLED = "coalesce(nullif(salary, ''), CASE WHEN seq % 3 = 0 THEN '$1/hr' END"
define(
    "processed_rows",
    f"""SELECT seq, CASE WHEN {_HELD} THEN 'PENDING' ELSE new_tier END AS tier, CASE WHEN {_HELD} THEN {q(process.PARKED)} ELSE new_reason END AS reason, CASE WHEN {_HELD} THEN 'General' ELSE {_RESUME} END AS suggested_resume,
    CASE WHEN {_HELD} THEN {_FILLED.replace("salary", "had")}, had) ELSE new_salary END AS salary, NOT {_HELD} AND new_tier IN ('APPLY', 'APPLY_CAVEAT') AS notify, description <> '' AS has_text FROM whole""",
    *_whole(f"{_FILLED}, {_SAID})"),
)
_HOURLY = f"CASE WHEN {phrases('title', gates.SENIOR_HOURLY)} THEN 'Senior-level title' WHEN {has('lower(title)', gates.INTERN_OR_STUDENT)} THEN 'Internship or student role' END"
define(
    "tenant_rows",
    f"""SELECT seq, tier, reason, salary, tier IN ('APPLY', 'APPLY_CAVEAT') AS notify FROM (
    SELECT seq, CASE WHEN gate IS NOT NULL THEN 'INELIGIBLE' ELSE {_ANY_VERDICT} END AS tier, coalesce(gate, 'told ' || seq) AS reason, CASE WHEN gate IS NOT NULL THEN salary ELSE coalesce(nullif(salary, ''), {_SAID}, {PAY}, salary) END AS salary
    FROM (SELECT *, {_HOURLY} AS gate FROM postings) WHERE gate IS NOT NULL OR NOT {_HELD})""",
)


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_ENTRY = (
    f"""'<div><b>' || tier || '</b> <a href="' || coalesce(nullif(apply_url, ''), nullif(url, ''), '#') || '">' || {_escaped('title')} || '</a><div>' || {_escaped('company')} """
    f"|| coalesce(' · ' || {_escaped("nullif(location, '')")}, '') || coalesce(' · <b>' || {_escaped("nullif(salary, '')")} || '</b>', '') || '</div></div>'"
)
define(
    "digest_page",
    f"""SELECT 'one' AS period, count(*) AS n, md5('<html><body><h2>Digest: ' || count(*) || ' new</h2>' || coalesce(string_agg(e, chr(10) ORDER BY tier, id, e), '<p>Nothing new.</p>') || '</body></html>') AS html_md5
    FROM (SELECT tier, id, {_ENTRY} AS e FROM postings WHERE found_s < 700000000 AND tier IN ('APPLY', 'APPLY_CAVEAT'))
    UNION ALL SELECT 'none', 0, md5('<html><body><h2>Digest: 0 new</h2><p>Nothing new.</p></body></html>')""",
)
