"""SC, SM, UD: files, streams, row functions. Queries that write use the cluster's shared folder."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..cluster import scratch, ship
from ..functions.text import render_template
from ..operators import upserts as u
from ..sources import files as f
from ..streaming import streams as st
from .catalog import query


def _session_files(t):
    """Conversations as JSON lines, a file each, in folders by date."""
    path = scratch(t.spark, "sessions")
    c = t.conversations.select("conv_id", F.struct(F.lit("message").alias("type"), "turn", "role", "text").alias("r"), "turn").groupBy("conv_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("turn", F.to_json("r").alias("j")))), lambda x: x["j"]), F.lit("not json")).alias("value"))
    name = F.concat(F.lit("session-2024-01-0"), (F.col("conv_id") % 5 + 1).cast("string"), F.lit("T00-00-00-00000000-0000-4000-8000-"), F.lpad(F.col("conv_id").cast("string"), 12, "0"))
    c.select("value", name.alias("name")).write.partitionBy("name").text(path)
    return path


def _sessions(t):
    """A partition folder stands for a file name here: Spark names its files itself."""
    raw = t.spark.read.option("wholetext", True).text(_session_files(t))
    lines = raw.select(F.concat("name", F.lit(".jsonl")).alias("file"), F.posexplode(F.split("value", "\n")).alias("ord", "line")).where("line <> ''")
    lines = lines.withColumn("s", f.session_name(F.col("file"))).where("s IS NOT NULL")
    return lines.select("s.ts", "s.id", "ord", F.from_json("line", "type string, turn long, role string, text string").alias("record"))


@query("SC1_session_tree", "SELECT conv_id, count(*) + 1 AS n, 1 + conv_id % 5 AS day FROM conversations GROUP BY 1")
def _(t):
    s = _sessions(t)
    return s.groupBy(F.substring("id", -12, 12).cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.dayofmonth("ts")).cast("long").alias("day"))


@query("SC2_flat_folder", "SELECT count(DISTINCT conv_id) AS files, count(*) AS n FROM conversations")
def _(t):
    s = _sessions(t).where("record.type IS NOT NULL")
    return s.agg(F.countDistinct("id").alias("files"), F.count(F.lit(1)).alias("n"))


@query("SC3_file_names", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) END AS ts, CASE WHEN page_id % 2 = 0 THEN '00000000-0000-4000-8000-' || lpad(CAST(page_id AS VARCHAR), 12, '0') END AS id FROM pages")
def _(t):
    at = F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, page_id)"), "yyyy-MM-dd'T'HH-mm-ss")
    name = F.concat(F.when(F.col("page_id") % 2 == 0, "session-").otherwise("Session-"), at, F.lit("-00000000-0000-4000-8000-"), F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(".jsonl"))
    return t.pages.select("page_id", f.session_name(name).alias("s")).select("page_id", F.col("s.ts").cast("timestamp_ntz").alias("ts"), "s.id")


@query("SC4_file_mtime", "SELECT r_name, true AS recent, 0::BIGINT AS micros FROM region")
def _(t):
    """A record's updated_at is its file's time, cut to milliseconds; files that were just written are an hour old at most."""
    path = scratch(t.spark, "mtime")
    t.region.write.json(path)
    at = f.updated_at(F.col("_metadata.file_modification_time"))
    rows = t.spark.read.schema("r_name string").json(path).select("r_name", at.alias("at"))
    return rows.select("r_name", (F.col("at") > F.current_timestamp() - F.expr("INTERVAL 1 HOUR")).alias("recent"), (F.unix_micros("at") % 1000).alias("micros"))


@query("SC5_head_summary", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM conversations) SELECT conv_id, turn FROM r WHERE n <= 2 OR (NOT seen AND n <= 5)")
def _(t):
    s = _sessions(t).where("record.type IS NOT NULL")
    return f.head_summary(s, F.col("record.role") == "assistant", 2, 3).select(F.substring("id", -12, 12).cast("long").alias("conv_id"), "record.turn")


@query("SC6_load_with_errors", "SELECT conv_id, count(*) AS n, 1::BIGINT AS errors FROM conversations GROUP BY 1")
def _(t):
    return f.parse_errors(_sessions(t), "type").select(F.substring("id", -12, 12).cast("long").alias("conv_id"), "n", "errors")


@query("SC8_csv_source", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', "' || p_brand || '"' AS name FROM part""")
def _(t):
    path = scratch(t.spark, "csv")
    rows = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name"))
    f.write_csv(rows, path)
    return f.read_csv(t.spark, path)


@query("SC9_csv_cells", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '"a,' || p_brand || '"' ELSE p_brand END AS cell FROM part""")
def _(t):
    return t.part.select("p_partkey", f.csv_cell(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a,"), "p_brand")).otherwise(F.col("p_brand"))).alias("cell"))


def _history(t):
    path = scratch(t.spark, "history")
    f.append_json(t.events.where("event_id % 2 = 0").select("event_id", "event_type"), path)
    f.append_json(t.events.where("event_id % 2 = 1").select("event_id", "event_type"), path)
    return t.spark.read.schema("event_id long, event_type string").json(path)


@query("SC10_append_history", "SELECT event_id, event_type FROM events")
def _(t):
    return _history(t)


@query("SC11_offset_lookup", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1 OFFSET 17")
def _(t):
    from pyspark.sql import Window

    h = _history(t).orderBy("event_id").limit(18).withColumn("ord", F.row_number().over(Window.orderBy("event_id")) - 1)
    return f.line_at(h, "ord", 17).select("event_id", "event_type")


@query("SC12_row_count", "SELECT count(*) AS n FROM events")
def _(t):
    return _history(t).agg(F.count(F.lit(1)).alias("n"))


def _bundle(t):
    path = scratch(t.spark, "bundle")
    payload = F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payload_id")
    f.write_bundle(t.events.select(F.col("event_id").alias("seq"), "event_type", payload), t.events.select(payload, "props"), path)
    return path


@query("SC13_trace_writer", "SELECT 'payloads' AS part, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events UNION ALL SELECT 'events', count(*), CAST(sum(strlen(event_type)) AS BIGINT) FROM events")
def _(t):
    """What lies in the two parts of a bundle; an event's payload is there before the event is."""
    path = _bundle(t)
    parts = [t.spark.read.schema(f"{c} string").json(f"{path}/{part}").agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(c)).alias("bytes")) for part, c in (("payloads", "props"), ("events", "event_type"))]
    return parts[0].unionByName(parts[1])


@query("SC14_trace_reader", "SELECT event_id AS seq, event_type, props FROM events")
def _(t):
    return f.read_bundle(t.spark, _bundle(t), "seq long, event_type string, payload_id string", "payload_id string, props string").select("seq", "event_type", "props")


def _ordered_events(t):
    return st.staged(t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value"), "events")


_SCHEMA = "event_id long, user_id long, event_type string, ts timestamp, value double"


@query("SC15_log_sink", "SELECT event_id, event_type FROM events")
def _(t):
    out = scratch(t.spark, "log-sink")
    st.drain_batches(st.file_stream(t.spark, _ordered_events(t), _SCHEMA, 2), scratch(t.spark, "check"), lambda df, n: df.select("event_id", "event_type").write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return t.spark.read.parquet(out).select("event_id", "event_type")


@query("SC16_table_scan", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'changed ' ELSE '' END || s_name AS s_name, s_suppkey % 4 = 0 AS s_late FROM supplier WHERE s_acctbal > 0")
def _(t):
    """A table of two writes, the second of which replaces rows of the first by key, and a filtered scan of it."""
    path = scratch(t.spark, "table")
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal", F.lit(False).alias("s_late"))
    rows.write.parquet(f"{path}/version=1")
    late = rows.where("s_suppkey % 4 = 0").withColumns({"s_name": F.concat(F.lit("changed "), "s_name"), "s_late": F.lit(True)})
    late.write.parquet(f"{path}/version=2")
    versions = t.spark.read.schema(f"{rows.schema.toDDL()}, version long").parquet(path).where("s_acctbal > 0")
    return u.upsert(versions.where("version = 1"), versions.where("version = 2"), ["s_suppkey"], "version").select("s_suppkey", "s_name", "s_late")


@query("SC17_sse_source", "SELECT page_id, 2 AS n, 'done' AS last, '{\"x\":' || page_id || '}' AS data FROM pages")
def _(t):
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit('event: item\ndata: {"x":'), n, F.lit("}\n\nevent: done\ndata: {}\n\nevent: late\ndata: 1\n\n"))
    e = f.until_completed(f.sse_events(text), "done")
    return t.pages.select("page_id", e.alias("e")).select("page_id", F.size("e").alias("n"), F.get("e", F.lit(1))["event"].alias("last"), F.get("e", F.lit(0))["data"].alias("data"))


def _paths(t):
    return t.pages.select(F.concat(F.when(F.col("page_id") % 3 == 0, ".git/").otherwise("src/"), F.col("page_id").cast("string")).alias("p"))


@query("SC18_tree_walk", "SELECT p FROM (SELECT CASE WHEN page_id % 3 = 0 THEN '.git/' ELSE 'src/' END || page_id AS p FROM pages) WHERE NOT starts_with(p, '.')")
def _(t):
    return f.visible_paths(_paths(t), "p")


@query("SC19_sorted_listing", "SELECT p, row_number() OVER (ORDER BY p) AS n FROM (SELECT 'src/' || page_id AS p FROM pages WHERE page_id % 3 <> 0) ORDER BY p LIMIT 200")
def _(t):
    """The first page of a listing in order, each entry with its place."""
    from pyspark.sql import Window

    return f.visible_paths(_paths(t), "p").orderBy("p").limit(200).withColumn("n", F.row_number().over(Window.orderBy("p")))


@query("SC22_paged_directory", "SELECT s_suppkey, s_name, (row_number() OVER (ORDER BY s_suppkey) - 1) // 40 AS page FROM supplier")
def _(t):
    """Pages of 40 from a source that gives a cursor with each, until it gives none."""
    return f.all_pages(t.spark, f.ordered_pages(t.supplier.select("s_suppkey", "s_name"), ["s_suppkey", "s_name"], 40), "s_suppkey long, s_name string")


@query("SC20_line_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS s FROM documents")
def _(t):
    return t.documents.select("doc_id", f.line_range(F.col("text"), 2, 3).alias("s"))


@query("SC21_isolated_batches", "SELECT event_id, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS batch FROM (SELECT *, CAST(event_type = 'error' OR coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'error', true) AS INT) AS o FROM events)")
def _(t):
    return f.event_batches(t.events, ["user_id"], "event_id", F.col("event_type") == "error").select("event_id", "batch")


@query("SM1_resumable_backfill", "SELECT event_id FROM events")
def _(t):
    """The second run begins after the first one's checkpoint and adds nothing."""
    path, out, check = _ordered_events(t), scratch(t.spark, "backfill"), scratch(t.spark, "check")
    for _ in range(2):
        got = st.drain(st.file_stream(t.spark, path, _SCHEMA, 1).select("event_id"), out, check)
    return got


@query("SM3_micro_batches", "SELECT count(*) AS n, 4 AS batches FROM events")
def _(t):
    out = scratch(t.spark, "micro")
    st.drain_batches(st.file_stream(t.spark, _ordered_events(t), _SCHEMA, 1), scratch(t.spark, "check"), lambda df, n: df.select("event_id").write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("batch").cast("int").alias("batches"))


@query("SM4_tail_follow", "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS poll FROM events WHERE event_type IN ('error', 'click')")
def _(t):
    """Two polls of a log that grows between them: the second one gets what the first has not seen, and no more."""
    path, check, out = scratch(t.spark, "log"), scratch(t.spark, "check"), scratch(t.spark, "tail")
    for poll in (1, 2):
        t.events.where(F.col("event_id") % 2 == poll - 1).select("event_id", "event_type").write.mode("append").parquet(path)
        s = st.file_stream(t.spark, path, "event_id long, event_type string").where("event_type IN ('error', 'click')")
        st.drain_batches(s, check, lambda df, n, poll=poll: df.write.mode("append").parquet(f"{out}/poll={poll}"))
    return t.spark.read.schema("event_id long, event_type string, poll int").parquet(out)


@query("SM6_narrowed_query", "SELECT doc_id FROM (SELECT doc_id, lower(left(text, 40)) AS h FROM documents) WHERE regexp_matches(h, '(?s)t.*h.*e')")
def _(t):
    """A query that goes on from the last one looks only at what that one found."""
    from ..operators import search as s

    heads = t.documents.select("doc_id", F.lower(F.substring("text", 1, 40)).alias("h"))
    first = s.narrowed(heads, "h", "th", None, None)
    return s.narrowed(heads, "h", "the", "th", first).select("doc_id")


#: Held so long, a lease that is not renewed may go to another worker.
_LEASE_SQL = """WITH b AS (SELECT user_id % 50 AS job, list([event_id * 7, event_id % 3]::BIGINT[] ORDER BY event_id) AS bs FROM events GROUP BY 1),
f AS (SELECT job, bs, list_reduce(bs, lambda a, x: CASE WHEN a[1] < 0 OR a[1] = x[2] OR x[1] >= a[2] THEN list_concat([x[2], x[1] + 900], a[3:], [x[2]]) ELSE list_concat(a, [a[1]]) END, [-1, 0]::BIGINT[]) AS a FROM b)
SELECT job, unnest(bs)[1] AS s, unnest(bs)[2] AS worker, unnest(a[3:]) AS held FROM f"""


@query("SM14_heartbeat_lease", _LEASE_SQL)
def _(t):
    from ..operators import jobs

    beats = t.events.select((F.col("user_id") % 50).alias("job"), (F.col("event_id") * 7).alias("s"), (F.col("event_id") % 3).alias("worker"))
    return jobs.leases(beats, ["job"], "s", "worker", 900)


@query("SM5_throttled_sets", """WITH RECURSIVE x AS (SELECT DISTINCT user_id, ts, event_type FROM events),
e AS (SELECT user_id, min(ts) AS at FROM x GROUP BY 1 UNION ALL SELECT e.user_id, greatest(e.at + INTERVAL 1 DAY, min(x.ts)) AS at FROM e JOIN x ON x.user_id = e.user_id AND x.ts > e.at GROUP BY e.user_id, e.at)
SELECT x.user_id, e.at AS start, list_sort(list(DISTINCT x.event_type)) AS items FROM x ASOF JOIN e ON x.user_id = e.user_id AND x.ts <= e.at GROUP BY 1, 2""")
def _(t):
    """The moments at which each user's changes go out, a day apart or more, and the kinds that each brings."""
    sets = st.throttled_sets(st.file_stream(t.spark, _ordered_events(t), _SCHEMA), "user_id", "ts", timedelta(days=1), "event_type")
    return st.drain_latest(sets, ["user_id", "ts"], scratch(t.spark, "sets"), scratch(t.spark, "check")).select("user_id", F.col("ts").cast("timestamp_ntz").alias("start"), "items")


def _chunks(t, rows, keys, parts):
    """Files of first, second, third chunks: a text goes on from batch to batch."""
    each = rows.select(*keys, F.posexplode(F.array(*parts)).alias("i", "c")).withColumn("ends", F.col("i") == len(parts) - 1)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.schema)
    return st.file_stream(t.spark, st.staged_in_order(each, "chunks", "i", len(parts)), schema, 1)


@query("SM8_tag_parser", "SELECT conv_id, turn, 'ab<' || '</h>' || turn AS shown, ['x' || turn, 'open' || turn] AS hidden FROM conversations")
def _(t):
    """Marks are cut by chunks that come in different batches; what only looks like one is shown; the last tag stays open."""
    n = F.col("turn").cast("string")
    parts = [F.lit("a<h"), F.concat(F.lit(">x"), n, F.lit("</")), F.concat(F.lit("h>b<</h>"), n, F.lit("<h>op")), F.concat(F.lit("en"), n)]
    s = st.parsed(_chunks(t, t.conversations, ["conv_id", "turn"], parts), ["conv_id", "turn"], "i", "c", "ends", st.tags("<h>", "</h>"))
    got = st.drain(s, scratch(t.spark, "tags"), scratch(t.spark, "check"))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "piece")))), lambda x: x["piece"])
    return got.groupBy("conv_id", "turn").agg(F.array_join(of("shown"), "").alias("shown"), of("hidden").alias("hidden"))


@query("SM9_patch_stream", "SELECT page_id, 2::BIGINT AS hunks, 'a' || chr(10) || 'z' || page_id || chr(10) || 'c' || chr(10) || 'e' || chr(10) AS s FROM pages")
def _(t):
    """Hunks are given out as soon as they are whole, lines and marks may be cut anywhere; then they are applied."""
    from ..functions.patch import apply_patch

    n = F.col("page_id").cast("string")
    parts = [F.lit("@@\n a\n-"), F.concat(F.lit("b\n+z"), n), F.lit("\n@"), F.lit("@\n c\n-d\n+e\n")]
    s = st.parsed(_chunks(t, t.pages, ["page_id"], parts), ["page_id"], "i", "c", "ends", st.hunk_parser)
    got = st.drain(s, scratch(t.spark, "hunks"), scratch(t.spark, "check"))
    per = got.groupBy("page_id").agg(F.count(F.lit(1)).alias("hunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("p"))
    return per.select("page_id", "hunks", apply_patch(F.lit("a\nb\nc\nd\n"), F.col("p")).alias("s"))


@query("SM10_wait_for_owner", "SELECT user_id, event_id FROM events WHERE event_type <> 'signup' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def _(t):
    s = st.file_stream(t.spark, _ordered_events(t), _SCHEMA, 2).select("user_id", "event_type", "event_id")
    return st.drain(st.buffered_until_owner(s, "user_id", "event_type", "signup", "event_id"), scratch(t.spark, "owner"), scratch(t.spark, "check"))


_FAN_SQL = """WITH j AS (SELECT p_brand, list([p_partkey, p_size]::BIGINT[] ORDER BY p_partkey) AS items FROM part GROUP BY 1),
f AS (SELECT p_brand, items, list_reduce(items, lambda a, x: list_concat(list_transform(a[1:8], lambda v, i: CASE WHEN i = list_position(a[1:8], list_min(a[1:8])) THEN v + x[2] ELSE v END), a[9:], [list_position(a[1:8], list_min(a[1:8])), list_min(a[1:8])]), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[])[9:] AS a FROM j),
e AS (SELECT p_brand, unnest(items) AS x, unnest(range(len(items))) AS k, a FROM f)
SELECT p_brand, x[1] AS p_partkey, CAST(a[2 * k + 1] AS INTEGER) AS slot, a[2 * k + 2] AS started, a[2 * k + 2] + x[2] AS ended FROM e"""


@query("SM15_bounded_fan_out", _FAN_SQL)
def _(t):
    """A job a brand; eight of its parts are worked on at once, each for as long as it is large."""
    from ..operators import jobs

    return jobs.fan_out(t.part, ["p_brand"], "p_partkey", "p_size", jobs.concurrency(8))


@query("SM16_late_rejected", "SELECT count(*) AS n FROM events WHERE event_type = 'click' AND value < 50")
def _(t):
    """Each click is an item that starts, fails if its value is below 50, and reports: a failed item's report comes late."""
    moves = {("pending", "start"): "running", ("running", "fail"): "failed", ("running", "report"): "completed"}
    commands = F.array(F.lit("start"), F.when(F.col("value") < 50, "fail"), F.lit("report"))
    given = t.events.where("event_type = 'click'").select("event_id", F.posexplode(commands).alias("o", "c")).where("c IS NOT NULL")
    return u.refused_commands(given, ["event_id"], "o", "c", moves, "pending").agg(F.coalesce(F.sum("refused"), F.lit(0)).alias("n"))


def _reviewer(task: str) -> str:
    """A deterministic worker: it counts its task, fails for some numbers and stops the job at others."""
    n = int(task.rpartition(" ")[2])
    if n % 7 == 0:
        return "not JSON"
    if n % 11 == 0:
        return f'{{"result": {{"size": "{n}"}}}}'
    return f'{{"result": {{"size": {len(task)}, "even": {"true" if n % 2 == 0 else "false"}}}, "stop": {"true" if n % 50 == 1 else "false"}}}'


@query("UD1_row_job", """WITH t AS (SELECT p_brand, p_partkey AS k, 'Review ' || p_brand || ' ' || p_partkey AS task, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 4 AS wave FROM part),
g AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'no JSON' WHEN k % 11 = 0 THEN 'field even' END AS wrong, k % 7 <> 0 AND k % 11 <> 0 AND k % 50 = 1 AS stop FROM t),
s AS (SELECT *, coalesce(wave <= min(wave) FILTER (WHERE stop) OVER (PARTITION BY p_brand), true) AS ran FROM g)
SELECT p_brand, k AS p_partkey, CASE WHEN NOT ran THEN 'pending' WHEN wrong IS NULL THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN ran AND wrong IS NULL THEN '{"even":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"size":' || length(task) || '}' END AS result, CASE WHEN ran THEN wrong END AS error FROM s""")
def _(t):
    """A job a brand, four rows at once; results are checked against two fields, and a worker may stop its job."""
    from ..operators import jobs

    task = render_template("Review {brand} {key}", {"brand": F.col("p_brand"), "key": F.col("p_partkey")})
    return jobs.row_job(t.part, ["p_brand"], "p_partkey", task, _reviewer, {"size": int, "even": bool}, 4)


@query("UD2_registered_tool", "SELECT p_partkey, p_size * 2 AS doubled FROM part")
def _(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tracemill_double(x INT) RETURNS INT RETURN x * 2")
    return t.part.select("p_partkey", F.expr("tracemill_double(p_size)").alias("doubled"))


@query("UD3_stored_cells", "SELECT user_id, CAST(sum(event_id) AS BIGINT) AS stored FROM events GROUP BY 1")
def _(t):
    """Cells that add to a stored value: the value is a fold over a user's cells in order."""
    return u.stored_cells(t.events, ["user_id"], "event_id", ["event_id"], F.lit(0).cast("long"), lambda stored, x: stored + x["event_id"])


@query("UD4_hooks", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1")
def _(t):
    """A callback a batch, for events that match."""
    from ..operators.filters import hook_matches

    out = scratch(t.spark, "hooks")
    s = st.file_stream(t.spark, _ordered_events(t), _SCHEMA, 2).where(hook_matches(F.lit("error|click"), F.col("event_type")))
    st.drain_batches(s, scratch(t.spark, "check"), lambda df, n: df.select("event_type").write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
