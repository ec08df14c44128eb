"""WN and TK: windows, paging, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import approx_token_count
from ..operators import windows as w
from .catalog import query
from .filter_queries import LOGS_SQL, logs


def sec(c="ts"):
    return F.unix_seconds(F.col(c).cast("timestamp"))


@query("WN1_strictly_increasing", """WITH r AS (SELECT event_id, user_id, (epoch_us(ts) // 1000000) // 3600 AS base, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, n + max(base - n) OVER (PARTITION BY user_id ORDER BY n) AS repaired FROM r""")
def _(t):
    e = t.events.select("event_id", "user_id", "ts", F.floor(sec() / 3600).alias("base"))
    return w.strictly_increasing(e, ["user_id"], "base", F.col("ts"), F.col("event_id")).select("event_id", "repaired")


@query("WN2_log_retention", f"""WITH l AS (SELECT *, coalesce('t:' || thread_id, 'none') AS part, strlen(level) + strlen(module) + strlen(file) + coalesce(strlen(body), 0) AS bytes FROM ({LOGS_SQL})),
r AS (SELECT *, sum(bytes) OVER (PARTITION BY part ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY part ORDER BY ts DESC, id DESC) AS n FROM l) SELECT id FROM r WHERE s <= 1500 AND n <= 40""")
def _(t):
    size = F.octet_length("level") + F.octet_length("module") + F.octet_length("file") + F.coalesce(F.octet_length("body"), F.lit(0))
    rows = logs(t).withColumn("part", F.coalesce(F.concat(F.lit("t:"), "thread_id"), F.lit("none")))
    return w.within_budget(rows, ["part"], size, [F.desc("ts"), F.desc("id")], 1500, 40).select("id")


@query("WN3_history_trim", """WITH r AS (SELECT conv_id, turn, strlen(text) AS b, sum(strlen(text)) OVER (PARTITION BY conv_id) AS total, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, turn FROM r WHERE total <= 1000 OR n = 1 OR s <= 800""")
def _(t):
    return w.trimmed_history(t.conversations, ["conv_id"], F.octet_length("text"), [F.desc("turn")], 1000).select("conv_id", "turn")


@query("WN4_latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(t):
    return w.latest_by(t.events, ["user_id"], F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("WN5_name_to_newest_id", """WITH l AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT event_type AS name, max_by(user_id, event_id) AS id FROM l JOIN (SELECT DISTINCT c_custkey FROM customer) ON user_id = c_custkey GROUP BY 1""")
def _(t):
    latest = w.latest_by(t.events, ["user_id"], F.desc("event_id"))
    found = latest.join(t.customer.select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    return found.groupBy(F.col("event_type").alias("name")).agg(F.max_by("user_id", "event_id").alias("id"))


def _turns(t):
    return t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("ord"), F.when(F.col("role") == "system", 0).when(F.col("turn") % 5 == 4, 2).otherwise(0).alias("pop")))).alias("ts"))


_KEPT = """WITH ts AS (SELECT conv_id, list([turn, CASE WHEN role = 'system' THEN 0 WHEN turn % 5 = 4 THEN 2 ELSE 0 END]::BIGINT[] ORDER BY turn) AS ts FROM conversations GROUP BY 1),
k AS (SELECT conv_id, ts, list_reduce(ts, lambda a, x: CASE WHEN x[2] > 0 THEN a[1:greatest(len(a) - x[2], 0)] ELSE list_append(a, x[1]) END, []::BIGINT[]) AS kept FROM ts)"""


@query("WN6_turns_after_rollback", f"{_KEPT} SELECT conv_id, kept FROM k")
def _(t):
    """Every fifth row but a system row takes the last two turns back."""
    return _turns(t).select("conv_id", w.surviving_turns(F.col("ts")).alias("kept"))


@query("WN7_fork_turns", f"""{_KEPT}, g AS (SELECT conv_id, kept, list_min(list_filter(list_transform(list_filter(ts, lambda x: x[2] = 0), lambda x: x[1]), lambda o: NOT list_contains(kept, o))) AS gone FROM k)
SELECT conv_id, CASE WHEN gone IS NULL THEN kept ELSE list_filter(kept, lambda o: o < gone) END AS kept FROM g""")
def _(t):
    kept = _turns(t).select("conv_id", w.surviving_turns(F.col("ts")).alias("kept"), "ts")
    # The suffix goes from the earliest rolled-back place on.
    gone = F.array_min(F.array_except(F.transform(F.filter("ts", lambda x: x["pop"] == 0), lambda x: x["ord"].cast("bigint")), F.col("kept")))
    return kept.select("conv_id", F.filter("kept", lambda x: F.coalesce(x < gone, F.lit(True))).alias("kept"))


@query("WN8_prefix_and_suffix", """WITH r AS (SELECT conv_id, turn, role, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
SELECT conv_id, turn, 'prefix' AS part FROM r WHERE k < 2 UNION ALL SELECT conv_id, turn, 'suffix' FROM r WHERE b < 1 OR (b = 1 AND role = 'user')""")
def _(t):
    user = F.col("role") == "user"
    a = w.before_nth(t.conversations, ["conv_id"], user, [F.col("turn")], 2).select("conv_id", "turn", F.lit("prefix").alias("part"))
    return a.unionByName(w.from_nth_last(t.conversations, ["conv_id"], user, ["turn"], 1).select("conv_id", "turn", F.lit("suffix").alias("part")))


@query("WN9_drop_last_turns", """WITH r AS (SELECT conv_id, turn, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM r WHERE k <= greatest(n - 2, 0)""")
def _(t):
    return w.without_last_turns(t.conversations, ["conv_id"], F.col("role") == "user", ["turn"], 2).select("conv_id", "turn")


@query("WN10_budget_fill", """WITH r AS (SELECT conv_id, turn, (strlen(text) + 3) // 4 AS n, sum((strlen(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) - (strlen(text) + 3) // 4 AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CAST(least(n, 150 - before) AS BIGINT) AS taken FROM r WHERE before < 150""")
def _(t):
    users = t.conversations.where("role = 'user'")
    return w.filled_newest_first(users, ["conv_id"], approx_token_count(F.col("text")), [F.desc("turn")], 150).select("conv_id", "turn", "taken")


@query("WN11_turn_budgets", """WITH m AS (SELECT conv_id, (strlen(text) + 3) // 4 AS n, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
t AS (SELECT conv_id, k, least(sum(n), 300) AS n FROM m GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING) - n AS before FROM t)
SELECT conv_id, k, CAST(least(n, 1200 - before) AS BIGINT) AS taken FROM s WHERE before < 1200""")
def _(t):
    """Turns from messages, newest first, 300 tokens a turn and 1200 in all; what a turn spends is after its cut."""
    m = t.conversations.select("conv_id", "turn", "role", approx_token_count(F.col("text")).alias("n"))
    island = F.count(F.when(F.col("role") == "user", 1)).over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = m.withColumn("k", island).groupBy("conv_id", "k").agg(F.least(F.sum("n"), F.lit(300)).alias("n"))
    spent = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("spent", spent).where(F.col("spent") - F.col("n") < 1200).select("conv_id", "k", F.least(F.col("n"), 1200 - (F.col("spent") - F.col("n"))).alias("taken"))


@query("WN12_item_budget", """WITH r AS (SELECT conv_id, turn, strlen(text) AS b, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - strlen(text) AS before FROM conversations)
SELECT conv_id, CAST(sum(CASE WHEN before < 900 THEN least(b, 900 - before) ELSE 0 END) AS BIGINT) AS shown, '[omitted ' || count(*) FILTER (WHERE before >= 900) || ' items]' AS note FROM r GROUP BY 1""")
def _(t):
    size = F.octet_length("text").cast("long")
    before = F.sum(size).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - size
    r = t.conversations.select("conv_id", size.alias("b"), before.alias("before"))
    shown = F.sum(F.when(F.col("before") < 900, F.least(F.col("b"), 900 - F.col("before"))).otherwise(0)).alias("shown")
    return r.groupBy("conv_id").agg(shown, F.concat(F.lit("[omitted "), F.count_if(F.col("before") >= 900).cast("string"), F.lit(" items]")).alias("note"))


@query("WN13_size_chunks", """WITH s AS (SELECT conv_id, list([strlen(text)]::BIGINT[] ORDER BY turn) AS sizes FROM conversations GROUP BY 1),
f AS (SELECT conv_id, list_reduce(sizes, lambda a, x: CASE WHEN a[1] > 0 AND a[1] + x[1] > 1500 THEN list_concat([x[1], a[2] + 1], a[3:], [a[2] + 1]) ELSE list_concat([a[1] + x[1], a[2]], a[3:], [a[2]]) END, [0, 0]::BIGINT[]) AS a FROM s)
SELECT conv_id, CAST(a[3:] AS INTEGER[]) AS chunk FROM f""")
def _(t):
    items = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.octet_length("text").cast("bigint").alias("b")))), lambda x: x["b"]).alias("sizes"))
    return items.select("conv_id", w.size_bounded_chunks(F.col("sizes"), 1500).alias("chunk"))


@query("WN14_head_tail", """WITH r AS (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS h, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS t FROM conversations) SELECT conv_id, turn FROM r WHERE h <= 500 OR t <= 500""")
def _(t):
    return w.head_and_tail(t.conversations, ["conv_id"], F.octet_length("text"), ["turn"], 500, 500).select("conv_id", "turn")


@query("TK1_created_desc", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 26")
def _(t):
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return w.page(t.orders, order, 26).withColumn("n", F.row_number().over(Window.orderBy(*order))).select("o_orderkey", "n")


@query("TK2_updated_desc", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '1970-01-01' ELSE ts END AS u FROM events) ORDER BY u DESC, event_id DESC LIMIT 40")
def _(t):
    u = F.coalesce(F.when(F.col("event_id") % 7 != 0, F.col("ts")), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return w.page(t.events.withColumn("u", u), [F.desc("u"), F.desc("event_id")], 40).select("event_id")


@query("TK3_keyset_anchor", "SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 1000 = 5) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def _(t):
    """Rows that share the anchor's time are left out, whatever their id."""
    at = t.orders.where("o_orderkey % 1000 = 5").agg(F.max("o_orderdate").alias("at"))
    rows = t.orders.crossJoin(F.broadcast(at))
    return w.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, F.col("o_orderdate") < F.col("at")).select("o_orderkey")


@query("TK4_thread_page", "SELECT conv_id FROM (SELECT conv_id, max(turn) AS u, min_by(text, turn) AS title FROM conversations GROUP BY 1) WHERE title ILIKE '%an%' ORDER BY u DESC, conv_id DESC LIMIT 15")
def _(t):
    rows = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("u"), F.min_by("text", "turn").alias("title"))
    return w.page(rows, [F.desc("u"), F.desc("conv_id")], 15, F.col("title").ilike("%an%")).select("conv_id")


@query("TK5_offset_page", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def _(t):
    return w.page(t.part, [F.desc("p_retailprice"), F.col("p_partkey")], 20, offset=40).select("p_partkey")


@query("TK6_scan_cap", "SELECT least(count(*), 500) AS n, count(*) > 500 AS capped FROM documents")
def _(t):
    """One row more than the cap tells whether it was hit."""
    n = F.count(F.lit(1))
    return t.documents.select("doc_id").limit(501).agg(F.least(n, F.lit(500)).alias("n"), (n > 500).alias("capped"))


@query("TK8_bucket_limits", """WITH b AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE p_brand END AS bucket, p_retailprice FROM part)
SELECT p_partkey, bucket FROM b QUALIFY bucket IS NULL OR row_number() OVER (PARTITION BY bucket ORDER BY p_retailprice DESC, p_partkey) <= CASE WHEN bucket = 'Brand#12' THEN 20 ELSE 8 END""")
def _(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("bucket"), "p_retailprice")
    return w.bucket_limits(rows, "bucket", [F.desc("p_retailprice"), F.col("p_partkey")], 8, {"Brand#12": 20}).select("p_partkey", "bucket")


@query("TK9_log_backfill", f"SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT id FROM ({LOGS_SQL}) ORDER BY id DESC LIMIT 200)")
def _(t):
    rows = w.page(logs(t), [F.desc("id")], 200)
    return rows.select("id", F.row_number().over(Window.orderBy("id")).alias("n"))


@query("TK10_two_way_cursor", "(SELECT 'next' AS way, event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 10) UNION ALL (SELECT 'back', event_id FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 10)")
def _(t):
    k = F.col("event_id")
    a = w.page(t.events, [k], 10, k > 500).select(F.lit("next").alias("way"), "event_id")
    return a.unionByName(w.page(t.events, [k.desc()], 10, k < 500).select(F.lit("back").alias("way"), "event_id"))
