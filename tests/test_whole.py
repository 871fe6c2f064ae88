"""Bounds that are part of a query's meaning, at their edge."""

import pytest

from tallysieve import synth
from tallysieve.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["blocked_pairs", "matched_pairs"])
def test_buckets_of_60_rows_make_pairs(spark, name, monkeypatch):
    rows = [(i, "Acme Rockets", "Data Engineer Intern", "Austin, TX", f"https://acme.example/{i}", None, False, str(i)) for i in range(60)]
    made = spark.createDataFrame(rows, "seq long, company string, title string, location string, url string, apply_url string, is_easy_apply boolean, id string")
    monkeypatch.setattr(synth, "postings", lambda spark, sf_dir: made)
    assert QUERIES[name](spark, SF).count() == 60 * 59 // 2
