"""Deduplication, resolution, state, views, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tallysieve.operators import dedup, graph, maintenance, resolve, sinks, state, views
from tallysieve.sources import boards, lists, pages, tracker
from tallysieve.streaming import feeds, ingest


def test_unseen_on_either_key(spark):
    batch = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", None)], "id string, norm_key string")
    stored = spark.createDataFrame([("1", "x"), ("9", "b"), ("8", None)], "id string, norm_key string")
    assert sorted(r.id for r in dedup.unseen(batch, stored).collect()) == ["3", "4"]


@pytest.mark.parametrize(("dropped", "kept"), [(False, [1, 3]), (True, [1])])
def test_greedy_dedup(spark, dropped, kept):
    rows = spark.createDataFrame([(1, "1", "a"), (2, "2", "a"), (3, "2", "b")], "seq long, id string, norm_key string")
    assert sorted(r.seq for r in dedup.greedy_dedup(rows, keys_of_dropped=dropped).collect()) == kept


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    found = {r.node: r.comp for r in graph.components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100
    assert graph.components(edges.limit(0)).count() == 0


_JOB = "id string, title string, company string, location string, url string, apply_url string, is_easy_apply boolean, status string, description string, found_at timestamp"


def jobs(spark, *rows):
    base = {"title": "Software Engineer Intern", "company": "Acme", "location": "Austin, TX", "url": None, "apply_url": None, "is_easy_apply": False, "status": "new", "description": "d"}
    out = []
    for i, r in enumerate(rows):
        x = {"id": str(i), "url": f"https://jobs.example.com/{i}"} | {k: v for k, v in base.items() if k != "url"} | r
        out.append((x["id"], x["title"], x["company"], x["location"], x["url"], x["apply_url"], x["is_easy_apply"], x["status"], x["description"], f"2024-01-{28 - i:02d} 00:00:00"))
    return spark.createDataFrame(out, _JOB.replace("found_at timestamp", "found_at string")).withColumn("found_at", F.to_timestamp("found_at"))


def groups(spark, *rows):
    return sorted(sorted([r.id, *(d.id for d in r.duplicates or [])]) for r in resolve.grouped(jobs(spark, *rows)).collect())


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ({"url": "https://x.wd5.myworkdayjobs.com/a/job/b/C_R12345-1", "title": "A"}, {"url": "https://x.wd5.myworkdayjobs.com/en-US/a/job/b/C_R12345", "title": "B"}, True),
        ({}, {}, True),
        ({"title": "Software Engineer Intern - Summer 2026"}, {"title": "Software Engineer Intern - Fall 2026"}, False),
        ({"location": "Austin, TX"}, {"location": "Dallas, TX"}, False),
        ({"location": None}, {"location": None}, False),
        ({"title": "Security Intern"}, {"title": "Application Intern"}, False),
        ({"company": "Acme Inc"}, {"company": "The Acme Group"}, True),
        ({"company": "Acme"}, {"company": "Zenith"}, False),
        ({"url": "https://careers.example.com/", "title": "Data Intern"}, {"url": "https://careers.example.com/", "title": "Cloud Intern"}, False),
    ],
)
def test_pairs(spark, a, b, same):
    assert (len(groups(spark, a, b)) == 1) is same


def test_group_leads_with_the_newest_and_takes_the_highest_status(spark):
    row = resolve.grouped(jobs(spark, {"status": "saved"}, {"status": "applied"}, {"company": "Zenith"})).where("duplicates IS NOT NULL").first()
    assert (row.id, row.status, [d.id for d in row.duplicates], row.duplicates[0].status) == ("0", "applied", ["1"], "applied")
    merged = resolve.merged(resolve.grouped(jobs(spark, {"status": "applied"})), jobs(spark, {"status": "new", "title": "Data Intern"}))
    assert [(r.title, r.status) for r in merged.collect()] == [("Data Intern", "applied")]


def test_strip_for_client(spark):
    out = views.strip_for_client(resolve.grouped(jobs(spark, {}, {}))).first()
    assert out.description is None and out.duplicates[0].description is None and out.duplicates[0].title


def test_set_group_status(spark):
    rows = jobs(spark, {}, {}, {})
    done = state.set_group_status(rows, ["0", "1", "0"], "saved")
    assert state.verify_status(done, ["0", "1"], "saved").isEmpty() and not state.verify_status(done, ["2"], "saved").isEmpty()
    for ids, status in ((["0"], "bad"), ([], "saved"), (["0", "77"], "saved"), ([str(i) for i in range(51)], "saved")):
        with pytest.raises(ValueError):
            state.set_group_status(rows, ids, status)


def test_mutations(spark):
    members = spark.createDataFrame([(1, "a", "new"), (1, "b", "new"), (2, "c", "saved")], "rn long, id string, status string")
    log = spark.createDataFrame([(1, ["a"], "saved", "new", "confirmed"), (2, ["b"], "applied", "new", "pending"), (3, ["c"], "saved", "new", "confirmed"), (4, ["c", "z"], "saved", "new", "confirmed")], "mutation_id long, ids array<string>, desired_status string, previous_status string, phase string")
    assert {r.rn: r.status for r in state.overlay(members, log).collect()} == {1: "applied", 2: "saved"}
    assert [r.mutation_id for r in state.acknowledged(members, log).collect()] == [3]
    failed = spark.createDataFrame([(2,), (3,)], "mutation_id long")
    assert [(r.id, r.status) for r in state.rolled_back(log, failed).collect()] == [("b", "new")]


def drain(spark, *outcomes):
    rows = spark.createDataFrame([(i, str(i), o) for i, o in enumerate(outcomes)], "found_at long, id string, outcome string")
    return [r.outcome for r in state.drained(rows).orderBy("found_at").collect()]


def test_drain_stops(spark):
    assert drain(spark, "ok", "billing", "ok") == ["ok", "billing"]
    assert drain(spark, "transient", "ok", "transient", "poison", "transient", "ok") == ["transient", "ok", "transient", "poison", "transient"]
    assert drain(spark, "poison", "poison", "ok") == ["poison", "poison", "ok"]


def test_alert_throttle_and_run_lock(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([("2024-01-01 07:00:00", "billing"), ("2024-01-01 05:00:00", "billing"), ("junk", "auth"), (None, "transient")], "mark string, kind string")
    assert [r[0] for r in rows.select(state.alert_due(F.col("mark"), now, F.col("kind"))).collect()] == [False, True, True, False]
    runs = spark.createDataFrame([("s", "2024-01-01 11:50:00"), ("t", "2024-01-01 11:00:00")], "source string, at string").select("source", F.to_timestamp("at").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    assert not state.run_allowed(runs, "s", now).first().allowed and state.run_allowed(runs, "t", now).first().allowed


def test_boards(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    workday = [{"total": 21, "jobPostings": [{"title": "A", "externalPath": "/job/a", "locationsText": "X", "postedOn": "Posted 3 Days Ago"}]}, {"total": 0, "jobPostings": [{"title": "B", "externalPath": "/job/b"}, {"title": "A", "externalPath": "/job/a"}]}, {"jobPostings": [{"title": "C", "externalPath": "/job/c"}]}]
    rows = [("w", "workday", "acme:wd5:site", k, json.dumps(p)) for k, p in enumerate(workday)]
    rows.append(("l", "lever", "", 0, json.dumps([{"text": "L", "hostedUrl": "https://l", "createdAt": 1692651521922}, {"text": "", "hostedUrl": "https://n"}])))
    rows += [("s", "smartrecruiters", "", 0, json.dumps({"content": [{"name": "S", "ref": "https://s", "location": {"city": "Paris", "region": "", "country": "fr"}}]})), ("g", "greenhouse", "", 0, "not json"), ("u", "unknown", "", 0, "{}")]
    found = {r.title: r for r in boards.board_listings(spark.createDataFrame(rows, "company string, platform string, token string, page int, payload string"), now).collect()}
    assert sorted(found) == ["A", "B", "L", "S"]
    assert found["A"].url == "https://acme.wd5.myworkdayjobs.com/site/job/a" and found["A"].posted_at.startswith("2024-01-07")
    assert found["L"].posted_at.startswith("2023-08-21T20:58:41") and found["S"].location == "Paris, fr"


def test_readme_lists(spark):
    html = "<table><tr><td>Acme</td><td>Intern</td><td>Austin</td><td><a href='https://a'>x</a></td><td>2d</td></tr><tr><td>↳</td><td>Data</td><td></td><td><a href='https://b'>x</a></td><td>9d</td></tr><tr><td>↳</td><td>Web<td>X</td><td><a href='https://c'>x</a></td><td>1d</td></tr></table>"
    pipe = "| not | a table |\n\n| Company | Role | Where | Link | Age |\n|---|---|---|---|---|\n| **Birch** | Intern | LA | <a href=\"https://d\">go</a> | 3d |\n| ↳ | Ops | LA | <a href=\"https://e\">go</a> | 0d |\n| short | row |\n"
    found = lists.readme_listings(spark.createDataFrame([("one", html), ("two", pipe)], "source_name string, text string"), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    got = {r.url: (r.company, r.title) for r in found.collect()}
    assert got == {"https://a": ("Acme", "Intern"), "https://c": ("Acme", "Web"), "https://d": ("**Birch**", "Intern"), "https://e": ("↳", "Ops")}


def test_pages():
    body = "word " * 60
    assert pages.content_text(f"<nav>menu</nav><div class='cookie-banner'>no</div><article>{body}</article>") == body.strip()
    assert pages.content_text("<p>short</p>") is None and pages.content_text(None) is None
    card = "<li><div data-entity-urn='urn:jobPosting:77'><h3 class='base-search-card__title'> Intern </h3><h4 class='base-search-card__subtitle'>Acme</h4><time datetime='2024-01-01'></time><a class='base-card__full-link' href='https://x/1?y=2'>Easy Apply</a></div></li><li>none</li>"
    assert pages.cards(card) == [{"id": "77", "title": "Intern", "company": "Acme", "location": "", "url": "https://x/1", "posted_at": "2024-01-01", "is_easy_apply": True}]


def test_page_details(spark):
    facts = json.dumps({"@type": "JobPosting", "url": "https://acme.example", "baseSalary": {"value": {"minValue": "80,000", "maxValue": 120000, "unitText": "YEAR"}}})
    html = f"<div class='show-more-less-html__markup'>About</div><script type='application/ld+json'>{facts}</script>"
    chip = "<ul class='description__job-criteria-list'>List</ul><span class='salary'>$25.00/hr - $30.00/hr</span> easy apply"
    one, two = pages.details(spark.createDataFrame([("1", html), ("2", chip)], "id string, html string")).orderBy("id").collect()
    assert (one.description, one.apply_url, one.is_easy_apply, one.salary) == ("About", "https://acme.example", False, "$80,000–$120,000 YEAR")
    assert (two.description, two.is_easy_apply, two.salary) == ("List", True, "$25–$30/hr")


def test_tracker(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿Company,Role,Link,Status\nAcme,Intern,https://www.a.com/x/,Applied \nBirch,Data Intern,,Applied\nNo,No,,Open\n', encoding="utf-8")
    stored = spark.createDataFrame([(1, "i1", "https://a.com/x?q=1", None, "k", "applied"), (2, "i2", "https://b.com", None, "birch|data", "new")], "seq long, id string, url string, apply_url string, norm_key string, status string")
    got = {r.company: (r.matched_id, r.method, r.already_applied) for r in dedup.match_tracker(stored, tracker.read_applied(spark, str(path))).collect()}
    assert got == {"Acme": ("i1", "url", True), "Birch": ("i2", "norm_key", False)}


def test_sinks(spark):
    rows = spark.createDataFrame([("1", "APPLY", "Ünï", "T", "", None, None, "https://u"), ("2", "INELIGIBLE", "x", "y", "", "", "", "")], "id string, tier string, company string, title string, location string, reason string, suggested_resume string, url string")
    (n,) = sinks.notices(rows).collect()
    assert (n.title_header, n.body, n.priority) == ("?n? - T", "APPLY", "high")
    page = sinks.digest(rows.withColumn("apply_url", F.lit("")).withColumn("salary", F.lit("$1"))).first()
    assert page.n == 1 and 'href="https://u"' in page.html


def test_maintenance_never_writes_status(spark):
    with pytest.raises(ValueError):
        maintenance._log(jobs(spark, {}), "x", "status", F.col("status"), F.lit("saved"))


def test_ingest_of_overlapping_deliveries(spark, tmp_path):
    schema = "seq long, id string, title string, company string, location string, url string, reason string, suggested_resume string, norm_key string, tier string, status string, found_at timestamp"
    def land(name, *ids):
        rows = spark.createDataFrame([(i, str(i), f"Intern {i}", "Acme", "", "", "", "", f"acme|{i}", "APPLY", "new", "2024-01-01 00:00:00") for i in ids], schema.replace("found_at timestamp", "found_at string")).withColumn("found_at", F.to_timestamp("found_at"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for ids in ((1, 2), (2, 3)):
        land("x", *ids)
        query = ingest.ingest(feeds.stream_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "offsets"))
        query.processAllAvailable()
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["1", "2", "3"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
