"""Sources, streams and merges that live between runs, against brute force."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallysieve.operators import dedup, graph, resolve, sinks, state
from tallysieve.operators.forms import unfilled
from tallysieve.sources import landed, lists
from tallysieve.streaming import feeds, ingest, outages
from tests.test_operators import jobs

RNG = random.Random(21)


@pytest.fixture(autouse=True)
def two_parts(spark):
    """Keyed state starts a worker for each partition and batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def card(k):
    return f'<li><div data-entity-urn="urn:li:jobPosting:{k}"><h3 class="base-search-card__title">T{k}</h3></div></li>'


def page(*keys):
    return "<ul>" + "".join(map(card, keys)) + "</ul>"


def tries(*attempts):
    return [{"attempt": k, "status": s, "body": b} for k, (s, b) in enumerate(attempts)]


FULL = (200, page(*range(10)))


# Paged sources ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("pages", "read"),
    [
        ([], []),
        ([tries(FULL), tries(FULL), tries((200, page(1)))], [(0, 10, None), (1, 10, None), (2, 1, "short")]),
        ([tries((429, None), (429, None), FULL), tries((429, None), (429, None), (429, None), FULL), tries(FULL)], [(0, 10, None), (1, 0, "rate_limited")]),
        ([tries((500, "x"), FULL), tries(FULL)], [(0, 0, "error")]),
        ([tries((200, ""), FULL), tries((200, ""), (200, None)), tries(FULL)], [(0, 10, None), (1, 0, "empty")]),
        ([tries((200, ""), (429, None), FULL), tries((200, ""), (500, None))], [(0, 10, None), (1, 0, "empty")]),
        ([tries((200, ""))], [(0, 0, "empty")]),
        ([[]], [(0, 0, "error")]),
    ],
)
def test_how_far_a_search_reads(pages, read):
    assert [(n, len(found), stop) for n, found, stop in landed.search_pages(iter(enumerate(pages)), 99)] == read


def test_a_search_reads_no_more_than_it_may():
    opened = []

    def pages():
        for n in range(9):
            opened.append(n)
            yield n, tries(FULL)

    assert len(list(landed.search_pages(pages(), 3))) == 3 and opened == [0, 1, 2, 3]
    opened.clear()
    assert [stop for *_, stop in landed.search_pages(iter([(0, tries((500, None))), (1, tries(FULL))]), 3)] == ["error"]


def board(*paths, total=0):
    return tries((200, json.dumps({"total": total, "jobPostings": [{"externalPath": f"/{p}"} for p in paths]})))


@pytest.mark.parametrize(
    ("pages", "read"),
    [
        ([board(*range(20), total=45), board(*range(20, 40)), board(*range(40, 60)), board(*range(60, 80))], [(0, None), (1, None), (2, "total")]),
        ([board(*range(20)), board(*range(20, 40), total=7), board(*range(40, 45))], [(0, None), (1, None), (2, "short")]),
        ([board(*range(20)), board(*range(20))], [(0, None), (1, "wrapped")]),
        ([board(*range(20)), tries((500, None)), board(*range(20, 40))], [(0, None), (1, "error")]),
        ([board(*range(20)), tries((200, "no json"))], [(0, None), (1, "error")]),
        ([board(*range(20)), board()], [(0, None), (1, "empty")]),
        ([tries((429, None), (429, None), (429, None))], [(0, "rate_limited")]),
        ([board(*range(20 * n, 20 * n + 20)) for n in range(205)], [(n, None) for n in range(199)] + [(199, "cap")]),
    ],
)
def test_how_far_a_board_reads(pages, read):
    assert [(n, stop) for n, _, stop in landed.board_pages(iter(enumerate(pages)), True)] == read


def land(folder, source, number, attempts, raw=None):
    at = folder / f"source={source}" / f"page={number}"
    at.mkdir(parents=True)
    (at / "part-0.json").write_text(raw or "\n".join(map(json.dumps, attempts)))
    (at / "_SUCCESS").write_text("")


@pytest.mark.parametrize("parts", [1, 3, 99])
def test_landed_searches(spark, tmp_path, parts):
    landed.register(spark)
    land(tmp_path, "a%2Fb", 0, tries(FULL))
    land(tmp_path, "a%2Fb", 1, tries((200, page(7, 8))))
    land(tmp_path, "broken", 0, None, raw='{"attempt": 0, "sta')
    land(tmp_path, "gap", 0, tries(FULL))
    land(tmp_path, "gap", 2, tries(FULL))
    rows = spark.read.format("landed_search").option("numPartitions", parts).option("path", str(tmp_path)).load()
    got = rows.groupBy("search_term", "page").agg(F.count("id").alias("n"), F.max("stopped").alias("stopped")).collect()
    assert sorted(map(tuple, got)) == [("a/b", 0, 10, None), ("a/b", 1, 2, "short"), ("broken", 0, 0, "error"), ("gap", 0, 10, None)]
    assert rows.rdd.getNumPartitions() == min(parts, 3)


def test_landed_boards_of_no_folder(spark, tmp_path):
    landed.register(spark)
    empty = spark.read.format("landed_boards").option("path", str(tmp_path / "none")).option("registry", "{}").load()
    assert empty.collect() == []


def put_feed(folder, name, *commits):
    at = folder / f"source={name}"
    at.mkdir(parents=True, exist_ok=True)
    (at / "feed.txt").write_text("<feed><id>tag</id>" + "".join(f"<entry><id>{c}</id></entry>" for c in commits) + "</feed>")


def test_a_restarted_stream_gives_no_list_twice(spark, tmp_path):
    landed.register(spark)
    seen = []

    def start():
        seen.clear()
        stream = spark.readStream.format("commit_feeds").option("path", str(tmp_path / "feeds")).load()
        feeds.run_available(stream, lambda batch, _: seen.extend(map(tuple, batch.collect())), str(tmp_path / "offsets")).awaitTermination()
        return sorted(seen, key=str)

    put_feed(tmp_path / "feeds", "one", "c1", "c0")
    put_feed(tmp_path / "feeds", "two")
    assert start() == [("one", "c1", None)]
    assert start() == []
    put_feed(tmp_path / "feeds", "two", "d1")
    put_feed(tmp_path / "feeds", "one")
    assert start() == [("two", "d1", None)]
    put_feed(tmp_path / "feeds", "one", "c2", "c1")
    assert start() == [("one", "c2", "c1")] and start() == []


def test_a_batch_of_commits_runs_again_alike():
    reader = landed.CommitReader({"path": "/nowhere"})
    between = lambda: list(reader.readBetweenOffsets({"a": "1", "b": "1"}, {"a": "2", "b": "1", "c": "1"}))
    assert between() == between() == [("a", "2", "1"), ("c", "1", None)]


# Tables of README texts ---------------------------------------------------------------------------------------------


def test_readme_rows_by_table_function(spark):
    html = '<table><tr><td>A</td><td>T</td><td>P</td><td><a href="u">x</a></td><td>1d</td></tr><tr><td>↳</td><td>T2</td><td><a href="v">x</a></td><td>2d</td></tr></table><table><tr><td>↳</td><td>T3</td><td>-</td><td>3d</td></tr></table>'
    pipes = "| C | R | L | Link | Age |\n|---|---|---|---|---|\n| **B** | R | L | <a href='w'>x</a> | 0d |\n| ↳ | R2 | L | none | 1d |\ntext\n| C | R | L | Link | Age |\n"
    texts = spark.createDataFrame([("h", html), ("p", pipes), ("both", html + "\n" + pipes), ("none", None), ("empty", "")], "source_name string, text string")
    got = [tuple(r) for r in lists.readme_rows(texts).collect()]
    h = [("A", "T", "P", "u", "1d"), ("A", "T2", "", "v", "2d"), ("↳", "T3", "", None, "3d")]
    p = [("**B**", "R", "L", "w", "0d"), ("↳", "R2", "L", None, "1d")]
    assert sorted(got, key=str) == sorted([("h", *r) for r in h] + [("p", *r) for r in p] + [("both", *r) for r in h + p], key=str)
    native = lists.html_table_rows(texts).unionByName(lists.pipe_table_rows(texts))
    assert sorted(map(tuple, native.select("source_name", "company", "title", "location", "apply_url", "age").collect()), key=str) == sorted(got, key=str)


# Outages ------------------------------------------------------------------------------------------------------------


def plain_notices(runs, hours=6):
    out = []
    for tenant in {r[0] for r in runs}:
        since = None
        for _, at, billing, auth, promoted in sorted({r[:2]: r for r in runs if r[0] == tenant}.values()):
            if promoted and since is not None:
                out.append((tenant, at, "recovery", None, promoted))
                since = None
            if billing + auth and (since is None or at - since >= dt.timedelta(hours=hours)):
                out.append((tenant, at, "alert", "billing" if billing else "auth", billing + auth))
                since = at
    return sorted(out, key=str)


def test_outages_are_told_once_over_a_replayed_stream(spark, tmp_path):
    schema = "tenant string, at timestamp, billing int, auth int, promoted int"
    runs = [(t, dt.datetime(2024, 1, 1 + h // 24, h % 24), *(RNG.choice([0, 0, 1, 3]) for _ in range(2)), RNG.choice([0, 0, 0, 0, 0, 5])) for t in "ab" for h in range(96)]
    got = []
    for hours in (30, 60, 96):
        part = runs[:hours] + runs[96 : 96 + hours]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = outages.outage_notices(feeds.stream_files(spark, str(tmp_path / "in"), schema, 10))
        feeds.run_available(stream, lambda batch, _: got.extend(map(tuple, batch.collect())), str(tmp_path / "offsets")).awaitTermination()
    assert sorted(got, key=str) == plain_notices(runs) and len(got) > 20


# Ingest -------------------------------------------------------------------------------------------------------------

_ARRIVAL = "seq long, id string, norm_key string, title string, company string, location string, url string, tier string, reason string, suggested_resume string"


def arrival(seq, i, k):
    return (seq, i, k, f"T{seq}", "C", "", "", "APPLY" if seq % 2 else "INELIGIBLE", "", "General")


def plain_ingest(batches):
    ids, keys, out = set(), set(), []
    for batch in batches:
        new_ids, new_keys = set(), set()
        for seq, i, k, *_ in sorted(batch):
            if i is None or i in ids or k is not None and k in keys or i in new_ids or k is not None and k in new_keys:
                continue
            new_ids.add(i)
            new_keys.add(k)
            out.append(seq)
        ids |= new_ids
        keys |= new_keys - {None}
    return sorted(out)


def test_ingest_keeps_what_the_store_lacks_and_reads_no_history(spark, tmp_path):
    seq, batches = 0, []
    for _ in range(4):
        batch = []
        for _ in range(20):
            seq += 1
            batch.append(arrival(seq, RNG.choice([None, *map(str, range(40))]), RNG.choice([None, *"abcdefghijklmnopqrstuvwxyz"])))
        batches.append(batch)
    (tmp_path / "in").mkdir()
    arrivals = feeds.stream_files(spark, str(tmp_path / "in"), _ARRIVAL)
    query = None
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, _ARRIVAL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 2:
            # A restart goes on from the offsets and the state.
            query.stop()
            query = None
        query = query or ingest.ingest(arrivals, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "offsets"))
        query.processAllAvailable()
    progress = query.recentProgress
    query.stop()
    stored = spark.read.schema(_ARRIVAL).parquet(str(tmp_path / "store"))
    assert sorted(r.seq for r in stored.collect()) == plain_ingest(batches)
    due = {r.id for r in stored.where("tier = 'APPLY'").collect()}
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == due
    # A batch reads its arrivals and what the one before has stored, however much there is.
    assert max(p.numInputRows for p in progress) <= 2 * 40
    assert sum(p.observedMetrics["arrivals"]["total_raw"] for p in progress if "arrivals" in p.observedMetrics) == 40


def test_a_mark_may_be_forgotten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arrivals = feeds.stream_files(spark, str(tmp_path / "in"), _ARRIVAL)
    query = ingest.ingest(arrivals, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "offsets"), forget_after=3600)
    came = lambda: sum(p.observedMetrics["arrivals"]["total_raw"] for p in query.recentProgress if "arrivals" in p.observedMetrics)
    for seq in (1, 2):
        spark.createDataFrame([arrival(seq, "x", "k")], _ARRIVAL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # Marks that may go keep the stream awake, so it never comes to rest.
        ends = time.monotonic() + 60
        while came() < seq and time.monotonic() < ends:
            time.sleep(0.3)
    query.stop()
    assert came() == 2 and [r.seq for r in spark.read.schema(_ARRIVAL).parquet(str(tmp_path / "store")).collect()] == [1]


# Feeds --------------------------------------------------------------------------------------------------------------


def test_late_rows_change_nothing_and_are_told(spark, tmp_path):
    schema = "ts timestamp, kind string"
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    seen = []
    for rows in ([(at(1), "a"), (at(1, 5), "a"), (at(3), "b")], [(at(1, 59), "a"), (at(2, 55), "b"), (at(2), "a")], [(at(5), "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen.append(feeds.count_windows(feeds.stream_files(spark, str(tmp_path / "in"), schema, 10), str(tmp_path), "ts", "kind"))
    # The mark is 2:50 after the first delivery: the hour from 1 is closed, that from 2 open.
    got = {(r.window.start.hour, r.kind): r.n for r in feeds.latest_windows(spark, str(tmp_path)).collect()}
    assert got == {(1, "a"): 2, (3, "b"): 1, (2, "b"): 1, (2, "a"): 1, (5, "a"): 1}
    assert [a for a, _ in seen] == [3, 3, 1] and [late > 0 for _, late in seen] == [False, True, False]


def test_change_feed_and_digests(spark, tmp_path):
    schema = "id string, tier string, found_at timestamp, title string, company string, location string, url string, apply_url string, salary string, reason string"
    row = lambda i, tier="APPLY": (i, tier, dt.datetime(2024, 1, 1), "T", "C", None, "u", None, None, None)
    got = []
    for rows in ([row("1"), row("gh:2"), row("3", "PENDING")], [row("1"), row("4"), row("ats:5")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.change_feed(feeds.stream_files(spark, str(tmp_path / "in"), schema))
        feeds.run_available(stream, lambda batch, _: got.extend(r.id for r in batch.collect()), str(tmp_path / "offsets")).awaitTermination()
    assert sorted(got) == ["1", "4"]
    write = feeds.digest_sink(str(tmp_path / "digests"))
    write(spark.createDataFrame([row("1"), row("2", "APPLY_CAVEAT"), row("3", "PENDING")], schema), 0)
    write(spark.createDataFrame([row("3", "PENDING")], schema), 1)
    write(spark.createDataFrame([row("1"), row("2", "APPLY_CAVEAT"), row("3", "PENDING")], schema), 0)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "digests")).collect()] == [2]


def test_statistics_of_a_run_are_counted_in_passing(spark, tmp_path):
    rows = spark.createDataFrame([(1, k % 3 == 0, "APPLY" if k % 2 else "PENDING", k % 5 == 0) for k in range(40)], "run_id int, stored boolean, tier string, rate_limited boolean")
    counts = sinks.observed_write(rows, str(tmp_path / "store"))
    assert counts == {k: v for k, v in state.run_statistics(rows).first().asDict().items() if k != "run_id"}
    assert spark.read.parquet(str(tmp_path / "store")).count() == counts["new_jobs"]
    assert sinks.observed_write(rows.limit(0), str(tmp_path / "none")) == {"total_raw": 0, "new_jobs": 0, "notified": 0, "rate_limited": 0}


# Deduplication, components, merges ----------------------------------------------------------------------------------


@pytest.mark.parametrize("keys_of_dropped", [False, True])
def test_greedy_dedup_is_the_scan_in_order(spark, keys_of_dropped):
    for size in (6, 40):
        rows = [(n, RNG.choice([None, *map(str, range(size // 3))]), RNG.choice([None, *"abcdefghijk"[: size // 4]]), "x") for n in range(size)]
        ids, keys, kept = set(), set(), []
        for n, i, k, _ in rows:
            fresh = (i is None or i not in ids) and (k is None or k not in keys)
            if fresh:
                kept.append(n)
                keys.add(k)
            if fresh or keys_of_dropped:
                ids.add(i)
        df = spark.createDataFrame(rows, "seq long, id string, norm_key string, i string").repartition(3)
        got = dedup.greedy_dedup(df, keys_of_dropped=keys_of_dropped)
        assert sorted(r.seq for r in got.collect()) == kept and got.columns == df.columns
    assert dedup.greedy_dedup(df.limit(0), keys_of_dropped=keys_of_dropped).collect() == []


def test_greedy_dedup_keeps_rows_without_a_key_and_one_of_equals(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "b", None), (4, "c", "k"), (5, "c", "l"), (6, "d", "l"), (6, "d", "l")], "seq long, id string, norm_key string")
    assert sorted(r.seq for r in dedup.greedy_dedup(rows).collect()) == [1, 2, 4, 6]


def test_components_of_a_hub_in_parts(spark):
    edges = spark.createDataFrame([(7, n) for n in range(100, 160)] + [(159, 3), (1, 2)], "a long, b long")
    found = {r.node: r.comp for r in graph.components(edges, split=5).collect()}
    assert found == {n: 3 for n in (3, 7, *range(100, 160))} | {1: 1, 2: 1}


def test_an_insert_that_runs_again_stores_the_same(spark):
    rows = [("1", "Acme", f"Intern {k}") for k in range(8)]
    got = set()
    for _ in range(3):
        RNG.shuffle(rows)
        batch = spark.createDataFrame(rows, "id string, company string, title string").repartition(4)
        got.add(tuple(dedup.insert_new(batch.limit(0).withColumn("norm_key", F.lit("")), batch).select("id", "title").first()))
    assert len(got) == 1


_TITLES = ("Software Engineer Intern", "Software Engineer Intern - Summer 2026", "Data Science Intern", "Data Intern")
_URLS = ("https://jobs.example.com/1", "https://boards.greenhouse.io/acme/jobs/{}", "https://www.linkedin.com/jobs/view/{}/", "bad {}")


def _random_jobs(spark, ids):
    rows = []
    for i in ids:
        r = random.Random(i * 7 + RNG.randint(0, 3))
        rows.append({"id": f"j{i}", "title": r.choice(_TITLES), "company": r.choice(["Acme", "Acme Labs", "Birch"]), "location": r.choice(["Austin, TX", "Boston, MA"]), "url": r.choice(_URLS).format(1000 + r.randint(0, 6)), "status": r.choice(["new", "saved", "applied"])})
    return jobs(spark, *rows)


def _flat(groups):
    out = set()
    for r in groups.collect():
        rest = [(d.id, d.title, d.status) for d in r.duplicates or []]
        out.add((r.id, r.title, r.status, tuple(rest)))
    return out


def _seconds(rows):
    # jobs() gives a day to each row; spread them so that every row has its own time.
    return rows.withColumn("found_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.hash("id"), F.lit(100_000))))


@pytest.mark.parametrize("ids", [(3, 30, 31), tuple(range(5, 9))])
def test_a_live_merge_is_a_full_regroup(spark, ids):
    old = _seconds(_random_jobs(spark, range(24)))
    groups = resolve.grouped(old)
    new = _seconds(_random_jobs(spark, ids))
    rank = {s: n for s, n in resolve.RANKS.items()}
    flat = {r.id: r for r in resolve.flattened(groups).collect()}
    for r in new.collect():
        was = flat.get(r.id)
        best = max((x.status for x in (was, r) if x is not None), key=rank.get)
        flat[r.id] = type(r)(**{**r.asDict(), "status": best})
    whole = spark.createDataFrame([flat[k] for k in sorted(flat)], old.schema)
    assert _flat(resolve.merged(groups, new)) == _flat(resolve.grouped(whole))


def test_a_merge_into_a_full_bucket_splits_it(spark):
    """The 61st row of a company ends comparison by metadata among all of them."""
    rows = _seconds(jobs(spark, *({"id": f"b{k}", "url": f"https://jobs.example.com/{k}"} for k in range(20))))
    more = _seconds(jobs(spark, *({"id": f"c{k}", "url": f"https://jobs.example.com/c{k}"} for k in range(20))))
    groups = resolve.grouped(rows.union(more).union(more.withColumn("id", F.concat(F.lit("d"), "id")).withColumn("url", F.concat("url", F.lit("d")))))
    assert groups.count() == 1
    one = rows.limit(1).withColumn("id", F.lit("last")).withColumn("url", F.lit("https://jobs.example.com/last"))
    assert resolve.merged(groups, one).count() == 61


def test_paths_to_fill_of_deep_profiles(spark):
    deep = {"z": "FILL_IN", "list": [{"x.y": "FILL_IN"}, *([0] * 10), "FILL_IN"], "n": None, "m": 5}
    for _ in range(6):
        deep = {"d": [deep]}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, '"FILL_IN"'), (3, "not json"), (4, None), (5, "[]")], "c long, p string")
    head = "d[0]." * 6
    got = {r.c: r.gaps for r in unfilled(rows, "c", "p").collect()}
    assert got == {1: [f"{head}list[0].x.y", f"{head}list[11]", f"{head}z"], 2: [""], 3: [], 4: None, 5: []}
