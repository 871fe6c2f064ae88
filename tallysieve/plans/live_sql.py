"""The queries of ``live`` in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

from tallysieve.plans.oracle import KEYED, SQL, define

#: Rounds that the SQL of the in-run deduplication is written out for; more than any test table needs.
_ROUNDS = 12


def greedy(name: str, source: str) -> tuple[str, ...]:
    """Tables that end in ``name``: rows of ``source`` (seq, id, norm_key) without an earlier kept row of their id or norm_key."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT seq, id, norm_key AS key FROM {source})"]
    for k in range(1, _ROUNDS + 1):
        out.append(f"{name}_k{k} AS MATERIALIZED (SELECT * FROM {name}_{k - 1} QUALIFY min(seq) OVER (PARTITION BY id) = seq AND (key IS NULL OR min(seq) OVER (PARTITION BY key) = seq))")
        out.append(f"{name}_{k} AS MATERIALIZED (SELECT * FROM {name}_{k - 1} r WHERE NOT EXISTS (SELECT 1 FROM {name}_k{k} x WHERE x.id = r.id) AND NOT EXISTS (SELECT 1 FROM {name}_k{k} x WHERE x.key = r.key))")
    out.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT seq, id, key AS norm_key FROM {name}_k{k}" for k in range(1, _ROUNDS + 1)) + ")")
    return tuple(out)


define(
    "dedup_greedy",
    "SELECT seq, id, norm_key FROM kept",
    "clashing AS (SELECT seq, 'u' || seq % 3001 AS id, 'n' || (seq % 3001 // 5) || '-' || seq % 7 % 3 AS norm_key FROM postings)",
    *greedy("kept", "clashing"),
)
define(
    "dedup_tenant",
    "SELECT seq, id, norm_key FROM firsts QUALIFY row_number() OVER (PARTITION BY coalesce('k' || norm_key, 'i' || id) ORDER BY seq) = 1",
    "keyed AS (SELECT seq, id, CASE WHEN seq % 13 <> 0 THEN 'n' || (seq // 3) || '-' || seq % 7 % 3 END AS norm_key FROM postings)",
    "firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)",
)
define(
    "paged_search",
    """SELECT 'term ' || search AS search_term, page, CASE WHEN stopped IS NULL OR stopped = 'short' THEN CAST(pos AS INT) END AS pos, CAST(CASE WHEN stopped IS NULL OR stopped = 'short' THEN n ELSE 0 END AS INT) AS n_listings, stopped,
    CASE WHEN stopped IS NULL OR stopped = 'short' THEN id END AS id, CASE WHEN stopped IS NULL OR stopped = 'short' THEN title END AS title
    FROM reached LEFT JOIN cards USING (search, page) WHERE pos IS NULL OR stopped IS NULL OR stopped = 'short' OR pos = 0""",
    "placed AS (SELECT seq, title, seq - seq % 40 AS search, CAST(seq % 40 // 10 AS INT) AS page FROM postings)",
    "cards AS (SELECT search, page, CAST(seq + 1000000 AS VARCHAR) AS id, title, row_number() OVER (PARTITION BY search, page ORDER BY seq) - 1 AS pos FROM placed WHERE seq % 23 <> 5)",
    "pages AS (SELECT search, page, count_if(seq % 23 <> 5) AS n, (search // 40 * 7 + page * 3) % 11 AS kind FROM placed GROUP BY search, page)",
    "judged AS (SELECT *, CASE WHEN kind = 1 THEN 'rate_limited' WHEN kind = 2 THEN 'error' WHEN kind = 4 OR n = 0 THEN 'empty' WHEN n < 10 THEN 'short' END AS stopped FROM pages)",
    "reached AS (SELECT * FROM judged QUALIFY count(*) OVER (PARTITION BY search ORDER BY page) = page + 1 AND coalesce(count_if(stopped IS NOT NULL) OVER (PARTITION BY search ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)",
)
define(
    "paged_boards",
    """SELECT 'ats:' || left(sha1(u), 16) AS id, title, 'Board ' || board AS company, location, u AS url FROM (
    SELECT board, title, trim(location) AS location, 'https://boards.example.com/' || seq AS u FROM placed WHERE kind = 2
    UNION ALL SELECT board, title, location, 'https://acme' || board || '.wd5.myworkdayjobs.com/careers/job/' || seq FROM placed JOIN reached USING (board, page) WHERE kind < 2 AND seq % 50 <> 25
    ) WHERE trim(title) <> ''""",
    "placed AS (SELECT seq, title, location, seq - seq % 50 AS board, seq // 50 % 4 AS kind, CASE WHEN seq // 50 % 4 < 2 THEN seq % 50 // 20 ELSE 0 END AS page FROM postings)",
    "pages AS (SELECT board, kind, page, count(*) AS n, kind = 1 AND page = 1 AND board // 200 % 3 = 0 AS failed FROM placed WHERE kind < 2 GROUP BY board, kind, page)",
    "ended AS (SELECT *, failed OR n < 20 OR (kind = 0 AND (page + 1) * 20 >= 35) AS stop FROM pages)",
    "reached AS (SELECT board, page FROM (SELECT *, count(*) OVER w AS k, coalesce(count_if(stop) OVER (PARTITION BY board ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM ended WINDOW w AS (PARTITION BY board ORDER BY page)) WHERE k = page + 1 AND over = 0 AND NOT failed)",
)
SQL["commit_stream"] = """
    WITH s AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 7 <> 0 THEN 'c' || s_suppkey % 3 END AS one, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || s_suppkey % 5 END AS two FROM supplier)
    SELECT 0 AS run, 'list' || s AS source_name, one AS commit, NULL AS previous FROM s WHERE one IS NOT NULL UNION ALL SELECT 1, 'list' || s, two, one FROM s WHERE two IS NOT NULL"""
SQL["outage_notices"] = """
    WITH RECURSIVE runs AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY happened) AS k FROM (
      SELECT 't' || user_id % 4 AS tenant, date_trunc('hour', ts) AS happened, count_if(event_type = 'error' AND event_id % 3 = 0) AS billing, count_if(event_type = 'error' AND event_id % 3 = 1) AS auth,
      count_if(event_type = 'purchase' AND event_id % 4 = 0) AS promoted FROM events WHERE user_id IS NOT NULL GROUP BY ALL)),
    told AS (
      SELECT DISTINCT tenant, CAST(0 AS BIGINT) AS k, NULL::TIMESTAMP AS happened, NULL::TIMESTAMP AS since, false AS ended, false AS alerted, CAST(0 AS BIGINT) AS billing, CAST(0 AS BIGINT) AS auth, CAST(0 AS BIGINT) AS promoted FROM runs
      UNION ALL
      SELECT tenant, k, happened, CASE WHEN alerts THEN happened WHEN ends THEN NULL ELSE since END, ends, alerts, billing, auth, promoted FROM (
        SELECT r.*, t.since, r.promoted > 0 AND t.since IS NOT NULL AS ends, r.billing + r.auth > 0 AND (t.since IS NULL OR r.promoted > 0 OR r.happened - t.since >= INTERVAL 6 HOURS) AS alerts FROM told t JOIN runs r ON r.tenant = t.tenant AND r.k = t.k + 1))
    SELECT tenant, CAST(epoch(happened) AS BIGINT) AS at_s, 'recovery' AS notice, NULL AS kind, promoted AS n FROM told WHERE ended
    UNION ALL SELECT tenant, CAST(epoch(happened) AS BIGINT), 'alert', CASE WHEN billing > 0 THEN 'billing' ELSE 'auth' END, billing + auth FROM told WHERE alerted"""
define(
    "stream_ingest",
    "SELECT seq, id, norm_key FROM one UNION ALL SELECT seq, id, norm_key FROM two",
    KEYED,
    *greedy("one", "(SELECT * FROM keyed WHERE seq % 3 < 2)"),
    "fresh AS (SELECT * FROM keyed k WHERE (seq % 3 = 2 OR seq % 10 = 1) AND NOT EXISTS (SELECT 1 FROM one WHERE one.id = k.id) AND NOT EXISTS (SELECT 1 FROM one WHERE one.norm_key = k.norm_key))",
    *greedy("two", "fresh"),
)
define(
    "readme_table_rows",
    """SELECT 'list' || tbl AS source_name, company, 'Intern ' || seq AS title, 'Austin, TX' AS location, CASE WHEN seq % 8 <> 5 THEN 'https://careers.example.com/' || seq END AS apply_url, seq % 10 || 'd' AS age FROM cells""",
    "raw AS (SELECT seq, seq - seq % 25 AS tbl, CASE WHEN seq % 25 > 0 AND seq % 3 = 1 THEN NULL ELSE 'Company ' || seq END AS own FROM postings)",
    "cells AS (SELECT seq, tbl, CASE WHEN tbl % 2 = 0 THEN last_value(own IGNORE NULLS) OVER (PARTITION BY tbl ORDER BY seq) ELSE coalesce(own, '↳') END AS company FROM raw)",
)
define(
    "observed_run",
    "SELECT count(*) AS total_raw, count_if(seq % 3 = 0) AS new_jobs, count_if(seq % 3 = 0 AND tier IN ('APPLY', 'APPLY_CAVEAT')) AS notified, count_if(seq % 11 = 0) AS rate_limited, count_if(seq % 3 = 0) AS written, CAST(sum(seq) FILTER (seq % 3 = 0) AS BIGINT) AS sum_seq FROM postings",
)
SQL["late_windows"] = """
    WITH e AS (SELECT event_type, date_trunc('hour', ts) AS h, event_id % 10 = 9 AS second, (SELECT max(ts) - INTERVAL 10 MINUTES FROM events WHERE event_id % 10 < 9) AS mark FROM events),
    kept AS (SELECT * FROM e WHERE NOT second OR h + INTERVAL 1 HOUR > mark)
    SELECT event_type, CAST(epoch(h) AS BIGINT) AS start_s, count(*) AS n FROM kept GROUP BY ALL UNION ALL SELECT 'late', NULL, (SELECT count(*) FROM e) - (SELECT count(*) FROM kept)"""
SQL["live_merge"] = SQL["grouped_rows"].replace("postings AS (SELECT", "every AS (SELECT", 1).replace(" FROM picked)", " FROM picked), postings AS (SELECT * REPLACE (CASE WHEN seq % 10 < 2 THEN status ELSE 'new' END AS status) FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)", 1)
define(
    "tracker_export",
    """SELECT CASE WHEN seq % 4 = 0 THEN 'The "' || company || '", Ltd' ELSE company END AS company, title AS role, url AS link FROM postings WHERE seq % 5 < 2""",
)
define(
    "application_platforms",
    """SELECT seq, CASE WHEN seq % 3 = 0 THEN ['avature', NULL, 'ibm', 'greenhouse'][CAST(seq % 4 + 1 AS INT)] WHEN contains(host, 'greenhouse.io') THEN 'greenhouse' WHEN contains(host, 'lever.co') THEN 'lever' WHEN contains(host, 'ashbyhq.com') THEN 'ashby'
    WHEN contains(host, 'myworkdayjobs.com') THEN 'workday' WHEN contains(host, 'icims.com') THEN 'icims' END AS platform FROM hosts""",
    "hosts AS (SELECT seq, regexp_extract(apply_url, '^https://([^/]+)', 1) AS host FROM postings)",
)
define("sampled_rows", "SELECT asked, least(asked, (SELECT count(*) FROM postings)) AS n, least(asked, (SELECT count(*) FROM postings)) AS n_distinct FROM (VALUES (100), (2000000000)) a(asked)")
