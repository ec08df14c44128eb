"""Queries do the whole job, against sets and rows counted here."""

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.parity import connect
from tracemill.functions import text
from tracemill.operators import graphs, jobs, reduce, upserts
from tracemill.plans import QUERIES
from tracemill.sources import files
from tracemill.streaming import streams


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def sent_out(changes, every):
    """[(moment, items)] of one key, a change at a time."""
    out, waiting = [], sorted(changes)
    while waiting:
        at = waiting[0][0] if not out else max(out[-1][0] + every, waiting[0][0])
        out.append((at, sorted({c for t, c in waiting if t <= at})))
        waiting = [(t, c) for t, c in waiting if t > at]
    return out


def test_all_throttled_sets(spark, sf):
    changes = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_type").collect():
        changes[r.user_id].append((r.ts, r.event_type))
    want = {(k, at): items for k, v in changes.items() for at, items in sent_out(v, timedelta(days=1))}
    got = QUERIES["SM5_throttled_sets"](spark, sf).collect()
    assert len(got) == len(want)
    assert {(r.user_id, r.start): r["items"] for r in got} == want


def test_throttled_sets_over_batches(spark, tmp_path):
    """Sets that wait from batch to batch, ties that batches divide, and a set that still waits at the end."""
    path, rng, changes = str(tmp_path / "in"), random.Random(11), defaultdict(list)
    start = datetime(2024, 1, 1)
    times = sorted(start + timedelta(hours=rng.randrange(0, 24 * 20, 3)) for _ in range(60))
    for i in range(0, 60, 12):
        rows = [(rng.randrange(2), t, rng.choice("abcd")) for t in times[i : i + 12]]
        for k, t, c in rows:
            changes[k].append((t, c))
        spark.createDataFrame(rows, "k long, at timestamp, kind string").coalesce(1).write.mode("append").parquet(path)
    s = streams.throttled_sets(streams.file_stream(spark, path, "k long, at timestamp, kind string", 1), "k", "at", timedelta(days=1), "kind")
    got = streams.drain_latest(s, ["k", "at"], str(tmp_path / "out"), str(tmp_path / "check")).collect()
    assert sorted((r.k, r["at"], r["items"]) for r in got) == sorted((k, *x) for k, v in changes.items() for x in sent_out(v, timedelta(days=1)))


def test_all_descendants_in_order(spark, sf):
    """Below root 0 there are all customers, one level a doubling."""
    ids = sorted(r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey >= 1").select("c_custkey").collect())
    assert len(ids) > 100
    got = [(r.depth, r.id) for r in QUERIES["TK11_descendant_order"](spark, sf).collect()]
    assert got == sorted((i.bit_length(), i) for i in ids)


def test_titles_are_whole(spark, sf):
    """The title is the whole trimmed text."""
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", "text").collect():
        if (r.text or "").strip(" "):
            turns[r.conv_id].append((r.turn, r.text.strip(" ")))
    got = {r.conv_id: r.title for r in QUERIES["AG4_thread_fold"](spark, sf).collect() if r.title is not None}
    assert got == {k: min(v)[1] for k, v in turns.items()}
    assert max(map(len, got.values())) > 60


@pytest.mark.parametrize("target, event, source, want", [("", 1, "a whole title", "a whole title"), ("kept", 1, "title", "kept"), ("", 0, "title", ""), ("", 1, "", ""), ("", 1, None, ""), (None, 1, "title", None)])
def test_backfill_conditions(spark, target, event, source, want):
    row = spark.createDataFrame([(target, event, source)], "target string, event int, source string")
    assert row.select(upserts.backfilled(F.col("target"), F.col("source"), F.col("event")).alias("v")).first().v == want


def test_late_commands_are_counted(spark):
    moves = {("pending", "start"): "running", ("running", "report"): "completed", ("running", "fail"): "failed"}
    rows = spark.createDataFrame([(1, 0, "start"), (1, 1, "fail"), (1, 2, "report"), (1, 3, "report"), (2, 0, "start"), (2, 1, "report"), (3, 0, "report")], "k int, o int, c string")
    assert {r.k: r.refused for r in upserts.refused_commands(rows, ["k"], "o", "c", moves, "pending").collect()} == {1: 2, 2: 0, 3: 1}


def test_cells_find_what_the_last_one_stored(spark):
    """The cell doubles and adds, so its result depends on the order."""
    rows = spark.createDataFrame([(1, 2, 5), (1, 0, 1), (1, 1, 3), (2, 0, 7)], "k int, o int, v long")
    got = upserts.stored_cells(rows, ["k"], "o", ["v"], F.lit(0).cast("long"), lambda stored, x: stored * 2 + x["v"])
    assert {r.k: r.stored for r in got.collect()} == {1: 15, 2: 7}


def test_queries_use_states_and_cells(spark, sf):
    for name, fold in (("SM16_late_rejected", "running"), ("UD3_stored_cells", "aggregate")):
        assert fold in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString(), name


def test_descendants_in_cycles(spark):
    """A cycle ends, also one that holds the root; a pruned edge takes its branch along."""
    rows = [(1, 2, "open"), (2, 3, "open"), (3, 1, "open"), (3, 4, "open"), (4, 5, "closed"), (5, 6, "open"), (7, 8, "open"), (8, 7, "open")]
    e = spark.createDataFrame(rows, "parent int, child int, status string")
    found = lambda *a: sorted((r.id, r.depth) for r in graphs.descendants(e, *a).collect())
    assert found(1) == [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5)] and found(1, "open") == [(2, 1), (3, 2), (4, 3)] and found(9) == []
    long = spark.range(1, 40).select((F.col("id") - 1).alias("parent"), F.col("id").alias("child"))
    assert [(r.id, r.depth) for r in graphs.descendants(long, 0).orderBy("id").collect()] == [(i, i) for i in range(1, 40)]


def test_templates_take_values_as_they_are(spark):
    row = spark.createDataFrame([("{b}", None)], "a string, b string")
    s = row.select(text.render_template("{a}{b}|{{a}}|{c}|{|}", {"a": F.col("a"), "b": F.col("b")}).alias("s")).first().s
    assert s == "{b}|{a}|{c}|{|}"


def brute_ids(snapshots):
    """Items by hand: the id at the same place if it has the content, else the first free one that has, else a new one."""
    before, following, out = [], 0, []
    for contents in snapshots:
        ids = [before[i][1] if i < len(before) and before[i][0] == c else None for i, c in enumerate(contents)]
        for i, c in enumerate(contents):
            if ids[i] is None:
                free = [x for y, x in before if y == c and x not in ids]
                ids[i] = free[0] if free else following
                following += not free
        before = list(zip(contents, ids, strict=True))
        out.append(ids)
    return out


def test_items_of_random_snapshots(spark):
    rng = random.Random(8)
    groups = {g: [[rng.choice("abc") for _ in range(rng.randrange(1, 7))] for _ in range(6)] for g in range(30)}
    rows = [(g, s, p, c) for g, snaps in groups.items() for s, snap in enumerate(snaps) for p, c in enumerate(snap)]
    rng.shuffle(rows)
    got = {(r.g, r.s, r.p): r.item_id for r in reduce.reconcile_snapshots(spark.createDataFrame(rows, "g int, s int, p int, c string"), "g", "s", "p", "c").collect()}
    assert got == {(g, s, p): i for g, snaps in groups.items() for s, ids in enumerate(brute_ids(snaps)) for p, i in enumerate(ids)}


@given(st.lists(st.sampled_from(["<h>", "</h>", "<", "/h", ">", "h", "a", "\n"]), max_size=14), st.lists(st.integers(0, 40), max_size=6))
def test_tags_wherever_chunks_are_cut(parts, cuts):
    whole = "".join(parts)
    cuts = sorted({min(c, len(whole)) for c in cuts} | {0, len(whole)})
    feed, state, got = streams.tags("<h>", "</h>"), "", []
    for a, b in zip(cuts, cuts[1:] + [len(whole)], strict=True):
        state, pieces = feed(state, whole[a:b], False)
        got += pieces
    got += feed(state, "", True)[1]
    assert "".join(t for k, t in got if k == "shown") == re.sub(r"(?s)<h>.*?(</h>|\Z)", "", whole)
    assert [t for k, t in got if k == "hidden"] == re.findall(r"(?s)<h>(.*?)(?:</h>|\Z)", whole)


@given(st.lists(st.sampled_from(["@@\n", " a\n", "-b\n", "+@@c\n", "@", "@x\n"]), max_size=14), st.lists(st.integers(0, 40), max_size=6))
def test_hunks_wherever_chunks_are_cut(parts, cuts):
    whole = "".join(parts)
    cuts = sorted({min(c, len(whole)) for c in cuts} | {0, len(whole)})
    state, got = "", []
    for a, b in zip(cuts, cuts[1:] + [len(whole)], strict=True):
        state, pieces = streams.hunk_parser(state, whole[a:b], False)
        got += [t for _, t in pieces]
    got += [t for _, t in streams.hunk_parser(state, "", True)[1]]
    assert got == (re.split(r"(?m)^(?=@@)", whole)[1:] if not whole.startswith("@@") else [x for x in re.split(r"(?m)^(?=@@)", whole) if x])


def test_slots_are_never_more_than_asked_for(spark, sf):
    rows = QUERIES["SM15_bounded_fan_out"](spark, sf).collect()
    jobs_ = defaultdict(list)
    for r in rows:
        jobs_[r.p_brand].append(r)
    for items in jobs_.values():
        for t in {r.started for r in items}:
            assert sum(r.started <= t < r.ended for r in items) <= 8
    assert [jobs.concurrency(x) for x in (None, 0, 8, 500)] == [16, 1, 8, 64] and jobs.concurrency(20, 4) == 4


@pytest.mark.parametrize("result, want", [("[1]", ("no object", False)), ('{"result": {"n": 1}}', (None, False)), ('{"result": {"n": true}}', ("field n", False)), ('{"result": {"n": 1}, "stop": true}', (None, True)), (None, ("no JSON", False)), ("{", ("no JSON", False))])
def test_results_of_workers(result, want):
    assert jobs.checked_result(result, {"n": int}) == want


def jobs_so_far(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


@pytest.mark.parametrize("n", [0, 1, 40, 41, 4000])
def test_directories_of_many_pages(spark, tmp_path, n):
    """Pages cost no jobs of their own: 100 of them take no more than 20."""
    spark.range(n).selectExpr("id * 3 AS s_suppkey", "'s' || id AS s_name").repartition(3).write.parquet(str(tmp_path / "supplier.parquet"))
    before = jobs_so_far(spark)
    got = sorted(tuple(r) for r in QUERIES["SC22_paged_directory"](spark, str(tmp_path)).collect())
    assert jobs_so_far(spark) - before <= 20
    assert got == [(i * 3, f"s{i}", i // 40) for i in range(n)]


def test_a_directory_of_more_rows_than_are_held(spark, tmp_path):
    """1500 pages off two ranges: as many jobs as a few pages take, and page numbers go on over the seam."""
    spark.range(59_999, -1, -1).selectExpr("id AS s_suppkey", "'s' || id AS s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    before = jobs_so_far(spark)
    got = sorted(tuple(r) for r in QUERIES["SC22_paged_directory"](spark, str(tmp_path)).collect())
    assert jobs_so_far(spark) - before <= 20
    assert got == [(i, f"s{i}", i // 40) for i in range(60_000)]


def test_pages_of_equal_and_missing_keys(spark):
    """Keys that pages divide lose no row; a cursor out of turn gives its own page."""
    keys = [1, 1, 1, 1, 2, 3, 3, None, None, None]
    rows = spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)], "k long, v string").repartition(4)
    fetch = files.ordered_pages(rows, ["k", "v"], 3, held_rows=2)
    want = [(k, str(i), i // 3) for i, k in enumerate(keys)]
    for held in (1, 1 << 20):
        got = files.all_pages(spark, fetch, "k long, v string", held)
        assert len(got.inputFiles()) == (4 if held == 1 else 1)
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    assert fetch(None) == ([r[:2] for r in want[:3]], 3)
    assert fetch(6) == ([r[:2] for r in want[6:9]], 9)
    assert fetch(3) == ([r[:2] for r in want[3:6]], 6)
    assert fetch(9) == ([want[9][:2]], None)
