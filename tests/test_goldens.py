"""Small cases whose results are known."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text as x
from tracemill.functions.patch import apply
from tracemill.operators import aggregates, filters, graphs, jobs, joins, reduce, search, upserts, windows
from tracemill.sources import files

EDGES = [(20, 22, "open"), (20, 21, "open"), (21, 24, "open"), (22, 23, "closed"), (20, 25, "closed"), (25, 26, "closed")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "parent long, child long, status string")


@pytest.mark.parametrize("status, want", [(None, [21, 22, 25, 23, 24, 26]), ("open", [21, 22, 24]), ("closed", [25, 26])])
def test_status_prunes_branches(edges, status, want):
    assert [r.id for r in graphs.descendants(edges, 20, status).orderBy("depth", "id").collect()] == want


def test_children(edges):
    assert {r.child for r in graphs.children(edges, 20, "open").collect()} == {21, 22}


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(
    "diff, want",
    [
        ("--- a/x\n+++ b/x\n@@ -1,2 +1,4 @@\n-old line\n+new line one\n+new line two\n+}\n keep", (3, 1)),
        ("--- /dev/null\n+++ b/x\n@@ -0,0 +1 @@\n+hello", (1, 0)),
        ("--- a/x\n+++ b/x\n@@ -1 +1 @@\n--- old value\n+++ new value", (1, 1)),
    ],
)
def test_diff_stats(spark, diff, want):
    got = one(spark, aggregates.diff_stats(F.lit(diff)))
    assert (got.added, got.deleted) == want


def test_template(spark):
    t = "Review {path} in {area}. Use {{literal}}. {missing}"
    assert one(spark, x.render_template(t, {"path": F.lit("a"), "area": F.lit("b")})) == "Review a in b. Use {literal}. {missing}"
    with pytest.raises(ValueError):
        x.strict_template("{{ a }} {{ b }}", {"a": F.lit(1)})


@pytest.mark.parametrize("cell, want", [("a,b", '"a,b"'), ('a"b', '"a""b"'), ("a", "a"), (None, "")])
def test_csv_cell(spark, cell, want):
    assert one(spark, files.csv_cell(F.lit(cell))) == want


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\n1,"alpha, beta"\n,\n2,gamma\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "alpha, beta"), ("2", "gamma")]
    (tmp_path / "b.csv").write_text("path,path\n1,2\n")
    with pytest.raises(ValueError, match="path is duplicated"):
        files.read_csv(spark, str(tmp_path / "b.csv"))


def test_late_report_is_refused(spark):
    moves = {("pending", "start"): "running", ("running", "report"): "completed", ("running", "fail"): "failed"}
    rows = spark.createDataFrame([(1, 0, "start"), (1, 1, "fail"), (1, 2, "report"), (2, 0, "start"), (2, 1, "report")], "k int, o int, c string")
    got = {r.k: (r.state, r.accepted) for r in upserts.run_state_machine(rows, ["k"], "o", "c", moves, "pending").collect()}
    assert got == {1: ("failed", 2), 2: ("completed", 2)}


def test_latest_name_wins(spark):
    rows = spark.createDataFrame([("a", "same", 0), ("b", "same", 1), ("b", "other", 2)], "id string, name string, ord int")
    got = windows.latest_by(rows, ["id"], F.desc("ord")).where("name = 'same'").collect()
    assert [r.id for r in got] == ["a"]


def test_history_keeps_the_newest(spark):
    rows = spark.createDataFrame([(1, 0, 50), (1, 1, 30), (1, 2, 200)], "k int, o int, n int")
    assert [r.o for r in windows.trimmed_history(rows, ["k"], F.col("n"), [F.desc("o")], 100).collect()] == [2]


def test_rollback_stack(spark):
    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(p).alias("pop")) for i, p in enumerate([0, 0, 0, 2, 0])])
    assert one(spark, windows.surviving_turns(turns)) == [0, 4]


def test_chunks(spark):
    assert one(spark, windows.size_bounded_chunks(F.array(*[F.lit(n).cast("long") for n in (5, 5, 1, 20, 3)]), 10)) == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("matcher, name, want", [(None, "a", True), ("", "a", True), ("*", "a", True), ("a|b", "b", True), ("a|b", "ab", False), ("^a.*", "abc", True), ("(bad", "bad", False), ("[z", "z", False)])
def test_hook_matcher(spark, matcher, name, want):
    assert one(spark, filters.hook_matches(F.lit(matcher), F.lit(name))) is want


@pytest.mark.parametrize("ip, want", [("10.1.2.3", True), ("8.8.8.8", False), ("172.31.0.1", True), ("172.32.0.1", False), ("host", False)])
def test_private_addresses(spark, ip, want):
    assert one(spark, filters.is_non_public_ip(F.lit(ip))) is want


def test_subsequence(spark):
    assert one(spark, search.subsequence_score(F.lit("hello"), "hl")) == -99
    assert one(spark, search.subsequence_score(F.lit("ahello"), "hl")) == 1
    assert one(spark, search.subsequence_score(F.lit("x"), "hl")) is None
    assert one(spark, search.subsequence_score(F.lit("x"), "")) == 2**31 - 1


def test_windows_of_lines(spark):
    d = spark.createDataFrame([("p", "alpha\n-\nbeta\nalpha\n-\n-\nbeta")], "path string, text string")
    got = search.matched_lines(d, "path", "text", ["alpha", "beta"], "all_within_lines", 3)
    assert sorted((r.line, r.last_line) for r in got.collect()) == [(1, 3), (3, 4)]


def test_patch():
    assert apply("a\nb\nc\n", "@@\n a\n-b\n+B\n c\n") == "a\nB\nc\n"
    assert apply("a\n  b\n", "@@\n-b\n+B\n") == "a\nB\n"
    assert apply("a\n", "@@\n-zz\n+B\n") is None
    assert apply("x\nf()\nx\ng()\nx\n", "@@ g()\n-x\n+y\n") == "x\nf()\nx\ng()\ny\n"


def test_unmatched_calls(spark):
    rows = spark.createDataFrame([(1, 0, "call", "c1", "x"), (1, 1, "call", "c2", "x"), (1, 2, "output", "c2", "y"), (1, 3, "output", "c9", "z")], "k int, ord int, kind string, call_id string, body string")
    made = joins.with_aborted_outputs(rows, ["k"]).orderBy("ord", "sub").collect()
    assert [(r.ord, r.sub, r.body) for r in made][:2] == [(0, 0, "x"), (0, 1, "aborted")]
    assert [r.ord for r in joins.without_orphan_outputs(rows, ["k"]).orderBy("ord").collect()] == [0, 1, 2]


def test_items_keep_their_ids(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "a"), (1, 1, 1, "x"), (1, 1, 2, "b"), (1, 1, 3, "b")]
    got = reduce.reconcile_snapshots(spark.createDataFrame(rows, "g int, s int, p int, c string"), "g", "s", "p", "c")
    assert [r.item_id for r in got.orderBy("s", "p").collect()] == [0, 1, 0, 2, 1, 3]


def test_strictly_increasing_is_the_recurrence(spark):
    import random

    rng = random.Random(3)
    base = [rng.randrange(20) for _ in range(60)]
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(base)], "k int, o int, b int")
    want, last = [], None
    for b in base:
        last = b if last is None else max(b, last + 1)
        want.append(last)
    assert [r.repaired for r in windows.strictly_increasing(df, ["k"], "b", F.col("o")).orderBy("o").collect()] == want


@pytest.mark.parametrize("s, n, want", [("añb", 2, "a"), ("añb", 3, "añ"), ("a", 5, "a"), ("日本", 4, "日")])
def test_byte_prefix(spark, s, n, want):
    assert one(spark, x.byte_prefix(F.lit(s), n)) == want


def test_secrets(spark):
    assert one(spark, x.redact_secrets(F.lit("token = abcdefgh12 sk-" + "a" * 24))) == "token = [REDACTED_SECRET] [REDACTED_SECRET]"


@pytest.mark.parametrize("n, want", [(-5, "0"), (999, "999"), (1200, "1.20K"), (10_000, "10.0K"), (999_499, "999K"), (999_500, "1.00M"), (123_456_789, "123M"), (1_234_567_890, "1.23G"), (1_234_000_000_000, "1234G")])
def test_si_suffix(spark, n, want):
    assert one(spark, x.si_suffix(F.lit(n))) == want


@pytest.mark.parametrize("ms, want", [(250, "250ms"), (1500, "1.50s"), (59_999, "60.00s"), (75_000, "1m 15s"), (3_600_000, "60m 00s")])
def test_elapsed(spark, ms, want):
    assert one(spark, x.elapsed(F.lit(ms))) == want


@pytest.mark.parametrize(
    "script, want",
    [
        ("ls -1", [["ls", "-1"]]),
        ("ls && pwd; echo 'hi there' | wc -l", [["ls"], ["pwd"], ["echo", "hi there"], ["wc", "-l"]]),
        ('git commit -m "line1\nline2"', [["git", "commit", "-m", "line1\nline2"]]),
        ("""echo "/usr"'/'"local"/bin""", [["echo", "/usr/local/bin"]]),
        ("""echo '/usr'"/"'local'/bin""", [["echo", "/usr/local/bin"]]),
        ("echo 123 456", [["echo", "123", "456"]]),
        ('rg -n "foo" -g"*.py"', [["rg", "-n", "foo", "-g*.py"]]),
        ("grep -n 'pattern' -g'*.txt'", [["grep", "-n", "pattern", "-g*.txt"]]),
        ("ls --color=never \\\n  src;\n\npwd\n", [["ls", "--color=never", "src"], ["pwd"]]),
        ('echo ""', [["echo", ""]]),
        ("", []),
        ("  \n", []),
        (None, None),
        *[
            (bad, None)
            for bad in (
                "(ls)", "ls || (pwd && echo hi)", "ls > out.txt", "echo hi & echo bye", "echo $(pwd)", "echo `pwd`", "echo $HOME", 'echo "hi $USER"', 'echo "hi ${USER}"', "FOO=bar ls",
                "ls &&", "&& ls", "ls ;; pwd", "ls | | wc", "ls |& wc", 'rg -g"$VAR" pattern', 'rg -g"$(pwd)" pattern', "ls # all", "! ls", "if true; then ls; fi", "123 x", "'ls' -l", "l's' -l", "echo \"\"''", 'echo "open', "a {b,c}", "[ -f x ]",
            )
        ],
    ],
)
def test_plain_commands(spark, script, want):
    assert one(spark, x.plain_commands(F.lit(script).cast("string"))) == want


def test_plain_commands_of_long_scripts(spark):
    words = ["w" * 50_000, *["a"] * 3000]
    assert one(spark, x.plain_commands(F.lit("ls " + " ".join(words) + " '" + "q" * 50_000 + "'"))) == [["ls", *words, "q" * 50_000]]


def test_item_ids(spark):
    def want(ids):
        seen, out = set(), []
        for i, base in enumerate(ids, 1):
            base = base if base and base.strip() else f"row-{i}"
            name, k = base, 2
            while name in seen:
                name, k = f"{base}-{k}", k + 1
            seen.add(name)
            out.append(name)
        return out

    import random

    rng = random.Random(5)
    pool = ["a", "a", "a-2", "a-2-2", "a-3", "a-02", "b", "b", "row-3", "row-3-2", "", None, " ", "c-1", "x-", "-2"]
    for ids in (["a", "a", "a"], ["a-2", "a", "a"], ["a", "a", "a-2"], [], *[[rng.choice(pool) for _ in range(60)] for _ in range(3)]):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(ids, 1)], "n long, v string")
        assert [r.item_id for r in jobs.item_ids(df, "n", "v").orderBy("n").collect()] == want(ids)
