"""Forms, search paging and descriptions behind links."""

import json

from pyspark.sql import functions as F

from tallysieve import synth
from tallysieve.functions import forms, urls
from tallysieve.operators import state
from tallysieve.operators.forms import chosen_options, logical_fields, unfilled
from tallysieve.operators.paging import pages_read
from tallysieve.sources import details
from tests.test_functions import values


def test_labels_ask_for_fields(spark):
    cases = {
        "Preferred first (given) name": "first_name", "LEGAL first name": "legal_first_name", "Address line 1": "address_street", "Address Line 2": None, "Business Unit": None,
        "Unit no. ": None, "Level of experience with GitHub": None, "GitHub": "github_url", "Do you reside in the U.S.?": "resides_in_us", "Statement": None, "": None, None: None,
    }
    assert values(spark, forms.field_of(F.col("x")), *cases) == list(cases.values())


def test_answers_come_from_the_profile_only(spark):
    profile = F.create_map(F.lit("email"), F.lit("a@example.org"))
    assert values(spark, forms.answer(F.col("x"), profile), "E-mail", "Gender", "Why?") == [("email", "a@example.org"), None, None]


def test_profile_values(spark):
    full = {"personal": {"legal_first_name": "Al", "preferred_first_name": "", "address": {"country": "Canada"}}, "work_authorization": {"us_citizen": False}}
    got = values(spark, forms.profile_values(F.col("x")), json.dumps(full), "{}", None)
    assert got[0] == {"first_name": "Al", "legal_first_name": "Al", "address_country": "Canada", "resides_in_us": "No", "us_citizen": "No"}
    assert got[1:] == [{}, {}] or got[1:] == [{}, None]


def test_unfilled_paths(spark):
    texts = ('{"a": {"b": "FILL_IN", "c": "FILL_IN now"}, "d": ["x", ["FILL_IN"]]}', "{}", None)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    assert [r.gaps for r in unfilled(rows, "k", "x").orderBy("k").collect()] == [["a.b", "d[1][0]"], [], None]


def test_option_names_are_whole(spark):
    got = values(spark, forms.option_names(F.col("x")), "Yes, I am.", "Extensive Experience. I am", "United States Minor", None)
    assert [set(x) for x in got] == [{"yes, i am.", "yes, i am", "yes"}, {"extensive experience. i am", "extensive experience", "extensive experience."}, {"united states minor"}, {""}]


def test_best_key(spark):
    keys = F.array(*map(F.lit, synth.ANSWER_KEYS))
    assert values(spark, forms.best_key(F.col("x"), keys), "NO", "no, I do not", "not sure", "yesterday", "maybe", None) == ["no", "no, i do", "not", "yes", None, None]


def test_unchosen_options(spark):
    cases = {"Select an option": True, "-- Select --": True, "Choose Financial Group": False, "Selected Employer": False, "N/A": True, "": True, "Please pick one": True}
    assert values(spark, forms.is_unchosen(F.col("x")), *cases) == list(cases.values())


def test_repeat_cells(spark):
    assert values(spark, forms.repeat_cell(F.col("x")), "37299-7-2", "10542-1", "a-b-c", None) == [("37299", "7", "2"), None, None, None]


def test_initials(spark):
    cases = {"Acme": "A", "\U0001f525 birch": "B", "Ōtsuka": "Ō", "(dune": "D", "": "?", None: "?", "--": "?"}
    assert values(spark, forms.avatar_letter(F.col("x")), *cases) == list(cases.values())


def test_application_platforms(spark):
    cases = {"https://careers.ibm.com/job/1": "ibm", "https://x.avature.net/a": "avature", "https://avature.net.example.org/a": None, "https://jobs.lever.co/a/b": "lever"}
    assert values(spark, urls.apply_platform(F.col("x")), *cases) == list(cases.values())


def test_radio_buttons_are_one_field(spark):
    rows = [("f", 1, "a", "x", "text"), ("f", 2, "r1", "g", "radio"), ("f", 3, "r2", "g", "radio"), ("f", 4, "", "y", "select"), ("f", 5, "1-2-3", "z", "text"), ("f", 6, None, None, None), ("f", 7, "a", "x", "text"), ("h", 2, "r1", "g", "radio")]
    found = logical_fields(spark.createDataFrame(rows, "form string, pos int, id string, name string, type string"), "^y$")
    assert sorted((r.form, r.key, r.kind or "", r.members) for r in found.collect()) == [("f", "", "", [6]), ("f", "a", "", [1]), ("f", "a", "", [7]), ("f", "g", "radio", [2, 3]), ("h", "g", "radio", [2])]


def test_ambiguous_options_are_refused(spark):
    wanted = spark.createDataFrame([("f", "k", "yes"), ("f", "k", "other"), ("f", "k", "United"), ("f", "q", "yes")], "form string, key string, value string")
    options = spark.createDataFrame([("f", "k", o) for o in ("Yes, I am.", "Other. A", "Other. B", "United States")], "form string, key string, option string")
    assert {(r.key, r.value): r.option for r in chosen_options(wanted, options).collect()} == {("k", "yes"): "Yes, I am.", ("k", "other"): None, ("k", "United"): None, ("q", "yes"): None}


def test_searches_end(spark):
    rows = [
        ("full", 0, None, 10, None, 3), ("full", 1, None, 0, 10, 0), ("full", 2, None, 0, 0, 0), ("full", 3, None, 10, None, 0), ("limited", 0, "rate_limited", 0, 0, 0), ("limited", 1, None, 10, None, 0),
        ("known", 0, None, 10, None, 10), ("known", 1, None, 10, None, 0), ("short", 0, None, 4, None, 0), ("fails", 0, "http 500", None, None, None),
    ]
    found = pages_read(spark.createDataFrame(rows, "search string, page int, error string, n_listings int, n_retry int, n_stored int"))
    assert sorted((r.search, r.page, r.stopped or "") for r in found.collect()) == [("fails", 0, "error"), ("full", 0, ""), ("full", 1, ""), ("full", 2, "empty"), ("known", 0, "known"), ("limited", 0, "rate_limited"), ("short", 0, "short")]


def test_recovery_is_announced_once(spark):
    rows = spark.createDataFrame([("2024-01-01", 2), (None, 2), ("2024-01-01", 0), ("2024-01-01", None)], "mark string, n int")
    assert [r[0] for r in rows.select(state.recovery_due(F.col("mark"), F.col("n"))).collect()] == [True, False, False, False]


def test_addresses_of_descriptions(spark):
    uuid = "0123abcd-0000-0000-0000-000000000000"
    cases = {
        "https://job-boards.greenhouse.io/acme/jobs/12?x=1": ["https://boards-api.greenhouse.io/v1/boards/acme/jobs/12"],
        f"https://jobs.lever.co/acme/{uuid}/apply": [f"https://api.lever.co/v0/postings/acme/{uuid}"],
        f"https://jobs.ashbyhq.com/acme/{uuid}": ["https://api.ashbyhq.com/posting-api/job-board/acme"],
        "https://acme.wd1.myworkdayjobs.com/en-US/Careers/job/Austin/R1": ["https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/en-US/Careers/job/Austin/R1", "https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/Careers/job/Austin/R1"],
        "https://acme.wd1.myworkdayjobs.com/Careers/job/Austin/R1/?q=1": ["https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/Careers/job/Austin/R1"],
        "https://acme.wd1.myworkdayjobs.com/Careers": [],
        "https://careers-acme.icims.com/jobs/1/job?a=1": ["https://careers-acme.icims.com/jobs/1/job?a=1&in_iframe=1"],
        "https://jobs.lever.co/acme": [],
        "https://example.org/a": ["https://example.org/a"],
        "": [],
        None: [],
    }
    assert values(spark, details.requests(F.col("x")), *cases) == list(cases.values())


def test_descriptions_of_landed_answers(spark):
    uuid = "0123abcd-0000-0000-0000-000000000000"
    page = "<body><nav>menu</nav><main>" + "word " * 60 + "</main></body>"
    rows = [
        ("https://boards.greenhouse.io/a/jobs/1", json.dumps({"content": "&lt;p&gt;Role&lt;/p&gt; one"}), "Role one"), ("https://boards.greenhouse.io/a/jobs/1", "{}", None), ("https://boards.greenhouse.io/a/jobs/1", None, None),
        (f"https://jobs.lever.co/a/{uuid}", json.dumps({"descriptionPlain": "x" * 13000}), "x" * 12000), (f"https://jobs.ashbyhq.com/a/{uuid}", json.dumps({"jobs": [{"id": "n"}, {"id": uuid, "descriptionPlain": "mine"}]}), "mine"),
        (f"https://jobs.ashbyhq.com/a/{uuid}", json.dumps({"jobs": []}), None), ("https://a.wd1.myworkdayjobs.com/b/job/c/d", json.dumps({"jobPostingInfo": {"jobDescription": "<p>Role</p>two"}}), "Role two"),
        ("https://a.icims.com/jobs/1", '<div class="iCIMS_JobContent">short</div>', None), ("https://example.org/a", page, ("word " * 60).strip()), ("https://example.org/a", None, None), (None, page, None),
    ]
    found = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(rows)], "i int, u string, p string").orderBy("i").select(details.description(F.col("u"), F.col("p"))).collect()
    assert [r[0] for r in found] == [want for _, _, want in rows]
