"""What keeps queries' cost from growing faster than their input."""

import json

from pyspark.sql import functions as F

from tallysieve import synth
from tallysieve.operators import forms, resolve, verdicts
from tallysieve.plans.queries import QUERIES
from tallysieve.sources import landed
from tallysieve.streaming import commits, feeds

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _pack(folder, name, *rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def _line(source, page, attempt, status, body, **more):
    return {"source": source, "page": page, "attempt": attempt, "status": status, "body": body, **more}


def test_postings_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(synth, "TASK_ROWS", 100)
    assert synth.postings(spark, SF).rdd.getNumPartitions() == 15


def test_packed_searches(spark, tmp_path):
    landed.register(spark)
    card = lambda k: f'<li><div data-entity-urn="urn:li:jobPosting:{k}"><h3 class="base-search-card__title">T{k}</h3></div></li>'
    full = "".join(map(card, range(10)))
    _pack(tmp_path, "part-0.json", _line("a", 0, 0, 429, None), _line("a", 0, 1, 200, full), _line("a", 1, 0, 200, card(7)), _line("a", 2, 0, 200, full), _line("gap", 0, 0, 200, full), _line("gap", 2, 0, 200, full))
    _pack(tmp_path, "part-1.json", _line("b", 0, 0, 500, None), _line("b", 1, 0, 200, full), _line("late", 1, 0, 200, full))
    (tmp_path / "_SUCCESS").write_text("")
    rows = spark.read.format("landed_search").option("packed", True).option("path", str(tmp_path)).load()
    got = rows.groupBy("search_term", "page").agg(F.count("id").alias("n"), F.max("stopped").alias("stopped")).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 10, None), ("a", 1, 1, "short"), ("b", 0, 0, "error"), ("gap", 0, 10, None)]
    assert rows.rdd.getNumPartitions() == 2


def test_packed_boards(spark, tmp_path):
    landed.register(spark)
    own = {"platform": "greenhouse", "token": "t"}
    _pack(tmp_path, "part-0.json", _line("a", 0, 0, 200, "{}", **own), _line("none", 0, 0, 200, "{}"), _line("z", 0, 0, 404, None, **own))
    rows = spark.read.format("landed_boards").option("packed", True).option("path", str(tmp_path)).load()
    assert sorted(map(tuple, rows.collect())) == [("a", "greenhouse", "t", 0, "{}", None), ("z", "greenhouse", "t", 0, None, "error")]


def test_options_are_not_sent_through_the_driver(spark):
    wanted = spark.createDataFrame([(1, "k", "yes"), (2, "k", "other"), (3, "k", "none")], "form int, key string, value string")
    options = wanted.select("form", "key", F.explode(F.array(F.lit("Yes, I do."), F.lit("Other. One"), F.lit("Other. Two"))).alias("option"))
    found = forms.chosen_options(wanted, options)
    assert sorted(map(tuple, found.collect())) == [(1, "k", "yes", "Yes, I do."), (2, "k", "other", None), (3, "k", "none", None)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_rows_of_pairs_have_their_features_made(spark):
    rows = synth.postings(spark, SF).withColumn("rn", F.col("seq"))
    asked = rows.select("rn").where("rn < 4")
    made = resolve.features_of(rows)(asked)
    # The features are projected from what the join has left.
    assert _plan(made).startswith("Project") and "LeftSemi" in _plan(made)
    assert made.count() == asked.count()


def test_first_rows_carry_no_other_columns(spark):
    assert "We build tools" not in _plan(QUERIES["dedup_first_per_key"](spark, SF))


def test_transitions_join_nothing(spark):
    assert "Join Inner" not in _plan(QUERIES["tier_transitions"](spark, SF))


def test_rules_match_in_capitals_and_over_blanks(spark):
    texts = ["A FULL-TIME POSITION.", "MUST BE ON ACTIVE DUTY.", "INTERNAL CANDIDATES ONLY", "ENROLLED IN A MASTER'S PROGRAM", "This  ROLE is\topen to <b>2026</b> Interns", "Co\top with Lakeside University"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, d string")
    gate = verdicts.insider_gate(F.lit("Engineer"), F.col("d"), F.lit("Acme"))["label"]
    got = rows.select("n", verdicts.is_full_time_only(F.col("d")), gate, verdicts.is_graduate_only(F.col("d")), verdicts.restricted_school(F.lit(""), F.col("d"))).orderBy("n").collect()
    assert [tuple(r)[1:] for r in got] == [
        (True, None, False, None), (False, verdicts.GROUP_LABELS["military"], False, None), (False, "internal candidates only", False, None),
        (False, None, True, None), (False, verdicts.GROUP_LABELS["restricted"], False, None), (False, None, False, "Lakeside University"),
    ]


def test_commits_are_told_once_over_restarts(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = []
    feed = lambda *c: "<feed><id>tag</id>" + "".join(f"<entry><id>{x}</id></entry>" for x in c) + "</feed>"
    landings = [[("one", feed("c1", "c0"), 0), ("two", feed(), 0)], [("one", feed(), 1), ("two", feed("d1"), 1), ("one", feed("c1"), 2)], [("one", feed("c2"), 3), ("one", feed("c3"), 4)]]
    for rows in landings:
        spark.createDataFrame(rows, commits.LANDED).write.mode("append").parquet(str(tmp_path / "in"))
        stream = commits.new_commits(feeds.stream_files(spark, str(tmp_path / "in"), commits.LANDED, 100))
        feeds.run_available(stream, lambda batch, _: got.append(sorted(map(tuple, batch.collect()))), str(tmp_path / "offsets")).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [x for x in got if x] == [[("one", "c1", None)], [("two", "d1", None)], [("one", "c3", "c1")]]
