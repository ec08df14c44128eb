"""JN, ST, DM, AG, GR: joins, set operations, state, rollups, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import approx_token_count
from ..operators import aggregates as a
from ..operators import graphs as g
from ..operators import joins as j
from ..operators import upserts as u
from ..operators.windows import latest_by, strictly_increasing
from .catalog import query
from .window_queries import sec

ITEMS_SQL = "SELECT user_id, event_id AS ord, CASE event_type WHEN 'view' THEN 'call' WHEN 'click' THEN 'output' ELSE 'note' END AS kind, (event_id % 40) AS call_id, event_type AS body FROM events"


def items(t):
    kind = F.when(F.col("event_type") == "view", "call").when(F.col("event_type") == "click", "output").otherwise("note")
    return t.events.select("user_id", F.col("event_id").alias("ord"), kind.alias("kind"), (F.col("event_id") % 40).alias("call_id"), F.col("event_type").alias("body"))


@query("JN1_two_level_names", "SELECT c_custkey, coalesce(s_name, n_name) AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_custkey")
def _(t):
    p = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"))
    q = t.nation.select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("name"))
    return j.with_name(t.customer.select("c_custkey"), p, q, "c_custkey")


@query("JN2_last_of_ids", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def _(t):
    ids = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return j.last_of_each(t.orders, ids, "o_custkey", F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("JN3_aborted_outputs", f"WITH i AS ({ITEMS_SQL}) SELECT user_id, ord, kind, call_id, body, 0 AS sub FROM i UNION ALL SELECT user_id, ord, 'output', call_id, 'aborted', 1 FROM i c WHERE kind = 'call' AND NOT EXISTS (SELECT 1 FROM i o WHERE o.kind = 'output' AND o.user_id = c.user_id AND o.call_id = c.call_id)")
def _(t):
    return j.with_aborted_outputs(items(t), ["user_id"])


@query("JN4_orphan_outputs", f"WITH i AS ({ITEMS_SQL}) SELECT user_id, ord, kind FROM i o WHERE kind <> 'output' OR EXISTS (SELECT 1 FROM i c WHERE c.kind = 'call' AND o.user_id = c.user_id AND o.call_id = c.call_id)")
def _(t):
    return j.without_orphan_outputs(items(t), ["user_id"]).select("user_id", "ord", "kind")


@query("JN5_remove_counterparts", f"WITH i AS ({ITEMS_SQL}) SELECT user_id, ord FROM i o WHERE NOT EXISTS (SELECT 1 FROM i r WHERE r.ord % 13 = 0 AND r.user_id = o.user_id AND r.call_id = o.call_id)")
def _(t):
    i = items(t)
    return j.without_counterparts(i, i.where("ord % 13 = 0"), ["user_id"]).select("user_id", "ord")


@query("JN6_previous_response", "SELECT b.event_id, a.event_type || '>' || b.event_type AS chain FROM events a JOIN events b ON b.event_id = a.event_id + 3")
def _(t):
    prev = t.events.select((F.col("event_id") + 3).alias("event_id"), F.col("event_type").alias("before"))
    return t.events.join(prev, "event_id").select("event_id", F.concat("before", F.lit(">"), "event_type").alias("chain"))


@query("JN7_positional_match", "SELECT a.conv_id, a.turn, a.text IS NOT DISTINCT FROM b.text AS same FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id + 2 AND b.turn = a.turn")
def _(t):
    b = t.conversations.select((F.col("conv_id") - 2).alias("conv_id"), "turn", F.col("text").alias("other"))
    return t.conversations.join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("text").eqNullSafe(F.col("other")).alias("same"))


@query("JN8_start_end", "SELECT user_id, k, min(event_id) FILTER (WHERE event_type = 'view') AS started, max(event_id) FILTER (WHERE event_type = 'purchase') AS ended, CASE WHEN count(*) FILTER (WHERE event_type = 'view') = 0 THEN 'orphan' WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 'running' ELSE 'done' END AS status FROM (SELECT *, event_id % 20 AS k FROM events) GROUP BY 1, 2")
def _(t):
    kind = F.col("event_type")
    return j.start_end_pairs(t.events.withColumn("k", F.col("event_id") % 20), ["user_id", "k"], kind == "view", kind == "purchase", F.col("event_id"))


@query("JN9_handle_bridge", "SELECT l_orderkey, l_linenumber, count(*) AS n, max(o_custkey) AS o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(t):
    li = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return li.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


@query("JN10_first_unused", "WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view'), r AS (SELECT user_id, event_id AS to_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click') SELECT user_id, event_id, coalesce(to_id, -1) AS to_id FROM l LEFT JOIN r USING (user_id, n)")
def _(t):
    l, r = t.events.where("event_type = 'view'").select("user_id", "event_id"), t.events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("to_id"))
    return j.paired_by_order(l, r, ["user_id"], "event_id", "to_id").select("user_id", "event_id", F.coalesce("to_id", F.lit(-1)).alias("to_id"))


@query("JN11_successor", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT a.event_id, b.event_id AS next_id FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.n = a.n + 1")
def _(t):
    from pyspark.sql import Window

    return t.events.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_id"))


@query("JN12_scalar_subquery", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
def _(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left")


@query("JN13_rule_priority", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'forbidden' WHEN page_id % 4 < 3 THEN 'allow' ELSE 'prompt' END AS decision FROM pages")
def _(t):
    rules = t.spark.createDataFrame([("ls", "allow"), ("/opt/ls", "forbidden")], "name string, decision string")
    p = F.when(F.col("page_id") % 4 == 0, "/opt/ls").when(F.col("page_id") % 4 == 1, "ls").when(F.col("page_id") % 4 == 2, "/bin/ls").otherwise("/bin/rm")
    return j.rule_for(t.pages.select("page_id", p.alias("program")), rules, "program").select("page_id", "decision")


@query("JN14_directory_merge", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.name IS NULL OR a.name = coalesce(a.k, b.k) THEN coalesce(b.name, a.name) ELSE a.name END AS name, list_sort(list_distinct(list_concat(coalesce(a.labels, []), coalesce(b.labels, [])))) AS labels, coalesce(a.bal, b.bal) AS bal
FROM (SELECT 'k' || c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'k' || c_custkey ELSE c_name END AS name, ['x', c_mktsegment] AS labels, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS bal FROM customer) a
FULL JOIN (SELECT 'k' || s_suppkey AS k, s_name AS name, ['x', 's'] AS labels, s_acctbal AS bal FROM supplier) b ON a.k = b.k""")
def _(t):
    k = lambda c: F.concat(F.lit("k"), F.col(c).cast("string"))
    c = t.customer.select(k("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, k("c_custkey")).otherwise(F.col("c_name")).alias("name"), F.array(F.lit("x"), "c_mktsegment").alias("labels"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("bal"))
    s = t.supplier.select(k("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.array(F.lit("x"), F.lit("s")).alias("labels"), F.col("s_acctbal").alias("bal"))
    return j.merged_directories(c, s, "k", ["bal"], "labels")


@query("JN15_deepest_root", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a' END AS root FROM pages")
def _(t):
    roots = t.spark.createDataFrame([("a",), ("a/b",), ("a/bc",)], "root string")
    p = F.when(F.col("page_id") % 3 == 0, "a/b/c").when(F.col("page_id") % 3 == 1, "a/x/b").otherwise("z/a")
    return j.deepest_root(t.pages.select("page_id", p.alias("path")), roots, "path", "root").select("page_id", "root")


@query("JN16_validated_path", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN -o_custkey ELSE o_custkey END AS path FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def _(t):
    good = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("good"))
    return t.orders.join(good, "o_custkey", "left").select("o_orderkey", F.when(F.col("good"), F.col("o_custkey")).otherwise(-F.col("o_custkey")).alias("path"))


@query("JN17_workspace_diff", "SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT p_partkey AS k, p_size AS d FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey AS k, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS d FROM part WHERE p_partkey % 3 <> 0) b ON a.k = b.k WHERE a.d IS DISTINCT FROM b.d")
def _(t):
    x = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("digest"))
    y = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"), (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).alias("digest"))
    return j.workspace_diff(x, y)


@query("JN18_short_page", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 30) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)")
def _(t):
    """Rows whose file is gone leave the page after its limit, which it may then fall short of."""
    return t.orders.orderBy(F.desc("o_orderkey")).limit(30).join(t.customer.where("c_acctbal > 2000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("ST1_recursive_union", "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey, n + max(o_orderkey // 100 - n) OVER (PARTITION BY o_custkey ORDER BY n) AS repaired FROM r")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.floor(F.col("o_orderkey") / 100).alias("base"))
    return strictly_increasing(rows, ["o_custkey"], "base", F.col("o_orderkey")).select("o_orderkey", "repaired")


@query("ST2_dedup_union", "SELECT id, min(src) AS src FROM (SELECT c_custkey AS id, 1 AS src FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 2 FROM orders UNION ALL SELECT s_suppkey, 3 FROM supplier) GROUP BY 1")
def _(t):
    ids = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("src")).unionByName(t.orders.select(F.col("o_custkey").alias("id"), F.lit(2).alias("src"))).unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.lit(3).alias("src")))
    return ids.groupBy("id").agg(F.min("src").alias("src"))


@query("ST3_set_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("ST4_pair_dedup", "SELECT DISTINCT p_brand, p_size % 2 = 0 AS recursive FROM part")
def _(t):
    return t.part.select("p_brand", (F.col("p_size") % 2 == 0).alias("recursive")).dropDuplicates()


@query("DM1_upsert", "SELECT k, CASE WHEN k % 3 = 0 THEN 'v' || (SELECT max(o_orderkey) FROM orders WHERE o_custkey = k) ELSE c_name END AS name FROM (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders WHERE o_custkey % 3 = 0) WHERE k % 3 <> 0 OR k IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    table = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    changes = t.orders.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("version"))
    return u.upsert(table, changes, ["k"], "version")


@query("DM2_insert_if_absent", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return u.insert_if_absent(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), ["k"])


MOVES = {("pending", "view"): "running", ("running", "click"): "completed", ("running", "error"): "failed", ("failed", "signup"): "pending"}


#: The same moves, with states and commands as places in lists: a fold in SQL takes numbers only.
DM3_SQL = """WITH c AS (SELECT user_id, list([list_position(['view', 'click', 'error', 'signup'], event_type)]::BIGINT[] ORDER BY event_id) AS cs FROM events GROUP BY 1),
s AS (SELECT user_id, list_reduce(cs, lambda a, x: CASE WHEN a[1] = 1 AND x[1] = 1 THEN [2, a[2] + 1] WHEN a[1] = 2 AND x[1] = 2 THEN [3, a[2] + 1] WHEN a[1] = 2 AND x[1] = 3 THEN [4, a[2] + 1] WHEN a[1] = 4 AND x[1] = 4 THEN [1, a[2] + 1] ELSE a END, [1, 0]::BIGINT[]) AS a FROM c)
SELECT user_id, ['pending', 'running', 'completed', 'failed'][a[1]] AS state, CAST(a[2] AS INTEGER) AS accepted FROM s"""


@query("DM3_state_machine", DM3_SQL)
def _(t):
    return u.run_state_machine(t.events, ["user_id"], "event_id", "event_type", MOVES, "pending")


@query("DM4_late_reports", "SELECT l.event_id, l.user_id % 7 = 3 AND s.event_type = 'view' AS accepted FROM events l LEFT JOIN events s ON s.event_id = l.event_id - 1 WHERE l.event_type = 'click'")
def _(t):
    """A report counts only while its item runs and comes from the worker it was given to."""
    before = t.events.select((F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("state"))
    r = t.events.where("event_type = 'click'").join(before, "event_id", "left")
    return r.select("event_id", F.coalesce((F.col("user_id") % 7 == 3) & (F.col("state") == "view"), F.when(F.col("user_id") % 7 != 3, False)).alias("accepted"))


@query("DM5_budget_account", "SELECT o_orderkey, used, CASE WHEN b IS NOT NULL AND used >= b THEN 'budget_limited' ELSE 'active' END AS status FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 500 END AS b, CAST(sum(o_orderkey % 100) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM orders)")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("tokens"), F.when(F.col("o_custkey") % 2 == 0, 500).alias("budget"))
    return u.budget_account(rows, ["o_custkey"], [F.col("o_orderkey")], "tokens", "budget").select("o_orderkey", "used", "status")


@query("DM6_status_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'budget_limited' WHEN o_orderkey % 2 = 1 AND o_totalprice >= 100000 THEN 'budget_limited' WHEN o_orderkey % 2 = 0 THEN 'paused' ELSE 'active' END AS status FROM orders")
def _(t):
    old, asked = F.when(F.col("o_orderstatus") == "F", "budget_limited").otherwise("active"), F.when(F.col("o_orderkey") % 2 == 0, "paused").otherwise("active")
    return t.orders.select("o_orderkey", u.status_update(old, asked, F.col("o_totalprice"), F.lit(100000)).alias("status"))


@query("DM7_lease_claim", "SELECT o_orderkey, o_orderstatus <> 'F' AND (o_orderstatus <> 'O' OR o_orderkey % 1000 < 100) AS claimed FROM orders")
def _(t):
    return t.orders.select("o_orderkey", ((F.col("o_orderstatus") != "F") & ((F.col("o_orderstatus") != "O") | (F.col("o_orderkey") % 1000 < 100))).alias("claimed"))


@query("DM8_claim_outcomes", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'up_to_date' WHEN o_orderkey % 5 = 0 THEN 'running' WHEN o_orderkey % 5 = 1 THEN 'retry_later' ELSE 'claimed' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    k = F.col("o_orderkey") % 5
    out = F.when(F.col("o_orderstatus") == "F", "up_to_date").when(k == 0, "running").when(k == 1, "retry_later").otherwise("claimed")
    return t.orders.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("DM9_select_and_prune", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def _(t):
    return t.orders.where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@query("DM10_usage_increment", "SELECT l_suppkey, count(*) AS uses FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("uses"))


@query("DM11_cascade", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def _(t):
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("DM12_derived_millis", "SELECT event_id, (epoch_us(ts) // 1000000) * 1000 AS ms FROM events")
def _(t):
    return t.events.select("event_id", (sec() * 1000).alias("ms"))


@query("DM13_backfill", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN text <> '' THEN text ELSE '' END ELSE role END AS v FROM conversations")
def _(t):
    """A user's turn has no value yet, any other has its role."""
    user = F.col("role") == "user"
    return t.conversations.select("conv_id", "turn", u.backfilled(F.when(user, "").otherwise(F.col("role")), F.col("text"), F.coalesce(user, F.lit(False)).cast("int")).alias("v"))


@query("DM14_prefer_existing", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, s_name) AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def _(t):
    e = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    return u.filled_from(e, t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name")), "c_custkey", ["name"])


@query("DM15_read_repair", "SELECT p_partkey, p_size + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS size FROM part WHERE p_partkey % 9 = 0")
def _(t):
    e = t.part.select("p_partkey", F.col("p_size").alias("size"))
    return u.changed_only(e, t.part.select("p_partkey", (F.col("p_size") + F.when(F.col("p_partkey") % 9 == 0, 1).otherwise(0)).alias("size")), "p_partkey", ["size"])


@query("DM16_layered_config", "SELECT 'a.b' AS path, '2' AS value UNION ALL SELECT 'a.c', '1' UNION ALL SELECT 'd', '3' UNION ALL SELECT 'e.x', '4'")
def _(t):
    rows = [("a.b", "1", 0), ("a.b", "2", 1), ("a.c", "1", 0), ("d.f", "1", 0), ("d", "3", 2), ("e", "1", 0), ("e.x", "4", 1)]
    return u.merged_layers(t.spark.createDataFrame(rows, "path string, value string, layer int"), "path", "value", "layer")


@query("DM17_edge_upsert", "SELECT o_custkey AS child, max_by(o_orderkey, o_orderkey) AS parent, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def _(t):
    return latest_by(t.orders, ["o_custkey"], F.desc("o_orderkey")).select(F.col("o_custkey").alias("child"), F.col("o_orderkey").alias("parent"), F.col("o_orderstatus").alias("status"))


@query("DM18_partial_patch", "SELECT user_id, max_by(CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type = 'view' THEN event_id END) AS a, max_by(CASE WHEN event_type = 'click' THEN event_id END, CASE WHEN event_type = 'click' THEN event_id END) AS b FROM events GROUP BY 1")
def _(t):
    p = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("a"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("b"))
    return u.latest_non_null(p, ["user_id"], ["a", "b"], "event_id")


@query("AG1_job_progress", "SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(t):
    return a.progress(t.orders, ["o_custkey"], "o_orderstatus", ["O", "F", "P"])


@query("AG2_max_default", "SELECT coalesce(max(event_id) FILTER (WHERE value > 1e12), 0) AS n FROM events")
def _(t):
    return t.events.where("value > 1e12").agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("n"))


@query("AG3_max_log_id", "SELECT coalesce(max(event_id), 0) AS n FROM events WHERE event_type = 'error'")
def _(t):
    return t.events.where("event_type = 'error'").agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("n"))


AG4_SQL = "SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS first_user_text, min_by(trim(text, ' '), turn) FILTER (WHERE role = 'user' AND trim(text, ' ') <> '') AS title, max_by(role, turn) AS last_role, count(*) AS n_items, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY 1"


@query("AG4_thread_fold", AG4_SQL)
def thread_fold(t):
    return a.thread_fold(t.conversations, "conv_id", "turn")


@query("AG5_fold_with_mode", "SELECT user_id, max(ts) AS updated, max_by(event_type, event_id) FILTER (WHERE event_type IN ('error', 'signup')) AS mode FROM events GROUP BY 1")
def _(t):
    k = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.max("ts").alias("updated"), a.last_where(k, F.col("event_id"), k.isin("error", "signup")).alias("mode"))


@query("AG6_project_groups", "SELECT c_nationkey, max(o_orderdate) AS latest, list(o_orderkey ORDER BY o_orderkey DESC)[1:5] AS newest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY c_nationkey = 3 DESC, latest DESC, c_nationkey LIMIT 8")
def _(t):
    """The five newest of each group come from a ranking, not from a list of all."""
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    from pyspark.sql import Window

    top = rows.withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("o_orderkey")))).where("rn <= 5").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("o_orderkey"), False).alias("newest"))
    best = rows.groupBy("c_nationkey").agg(F.max("o_orderdate").alias("latest")).orderBy((F.col("c_nationkey") == 3).desc(), F.desc("latest"), "c_nationkey").limit(8)
    return best.join(top, "c_nationkey")


@query("AG7_outcome_counts", "SELECT count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error') AS ok, sum(value) FILTER (WHERE value > 1e12) AS tokens FROM events")
def _(t):
    k = F.col("event_type")
    return t.events.agg(F.count_if(k == "error").alias("failed"), F.count_if(k != "error").alias("ok"), F.sum(F.when(F.col("value") > 1e12, F.col("value"))).alias("tokens"))


@query("AG8_metric_points", "SELECT event_type, coalesce(round(sum(value) FILTER (WHERE value >= 0), 4), 0) AS counter, count(value) AS n, [count(*) FILTER (WHERE value <= 10), count(*) FILTER (WHERE value > 10 AND value <= 50), count(*) FILTER (WHERE value > 50)] AS buckets FROM events GROUP BY 1")
def _(t):
    return a.metric_points(t.events, "event_type", [], "value", [10, 50]).withColumn("counter", F.round("counter", 4))


@query("AG9_runtime_summary", "SELECT CAST(round(sum(greatest(CASE WHEN event_type = 'view' THEN value ELSE 0 END, 0))) AS BIGINT) AS view_total, CAST(round(sum(greatest(CASE WHEN event_type = 'click' THEN value ELSE 0 END, 0))) AS BIGINT) AS click_total FROM events")
def _(t):
    s = lambda k: F.round(F.sum(F.when((F.col("event_type") == k) & (F.col("value") > 0) & ~F.isnan("value"), F.col("value")).otherwise(0.0))).cast("long").alias(f"{k}_total")
    return t.events.agg(s("view"), s("click"))


@query("AG10_merge_summaries", "SELECT user_id, round(sum(value), 4) AS total, max_by(value, event_id) FILTER (WHERE value > 20) AS gauge FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), a.last_where(F.col("value"), F.col("event_id"), F.col("value") > 20).alias("gauge"))


@query("AG11_strictest_decision", "SELECT user_id, ['allow', 'prompt', 'forbidden'][max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END)] AS decision FROM events GROUP BY 1")
def _(t):
    d = F.when(F.col("event_type") == "error", "forbidden").when(F.col("event_type") == "purchase", "prompt").otherwise("allow")
    return t.events.groupBy("user_id").agg(a.strictest(d).alias("decision"))


@query("AG12_network_lists", "SELECT user_id, max_by(event_type, event_id) AS decision, max(event_id) AS ord FROM events WHERE event_type <> 'click' GROUP BY 1")
def _(t):
    rows = t.events.select("user_id", F.when(F.col("event_type") == "click", "prompt").otherwise(F.col("event_type")).alias("decision"), F.col("event_id").alias("ord"))
    return a.last_decisions(rows, "user_id", "decision", "ord")


@query("AG13_token_estimate", "SELECT conv_id, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS n FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.sum(approx_token_count(F.col("text"))).alias("n"))


@query("AG14_usage_after_model", "WITH b AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS last FROM conversations GROUP BY 1) SELECT conv_id, CAST(coalesce(sum((strlen(text) + 3) // 4) FILTER (WHERE turn > coalesce(last, -1)), 0) AS BIGINT) AS after FROM conversations JOIN b USING (conv_id) GROUP BY 1")
def _(t):
    from pyspark.sql import Window

    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = t.conversations.withColumn("last", F.coalesce(last, F.lit(-1)))
    return rows.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("turn") > F.col("last"), approx_token_count(F.col("text")))), F.lit(0)).alias("after"))


@query("AG15_diff_stats", "SELECT page_id, 2 + page_id % 2 AS added, 1 AS deleted FROM pages")
def _(t):
    odd = F.col("page_id") % 2 == 1
    head = F.when(odd, "@@ -1,2 +1,4 @@").otherwise("@@ -1,2 +1,3 @@")
    d = F.concat(F.lit("--- a/x\n+++ b/x\n"), head, F.lit("\n keep\n--- old value\n+++ new value\n+b"), F.when(odd, "\n+c").otherwise(""), F.lit("\n--- a/y\n+++ b/y"))
    return t.pages.select("page_id", a.diff_stats(d).alias("s")).select("page_id", "s.added", "s.deleted")


@query("AG16_first_seen", "SELECT event_type, min(event_id) AS first FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.min("event_id").alias("first"))


@query("AG17_duplicate_suppression", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("AG18_first_then_fill", "SELECT l_orderkey, min_by(l_suppkey, l_suppkey) AS s, min(l_tax) FILTER (WHERE l_tax > 0.03) AS tax FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_suppkey", "l_suppkey").alias("s"), F.min(F.when(F.col("l_tax") > 0.03, F.col("l_tax"))).alias("tax"))


@query("AG19_turn_row", "SELECT user_id, event_id // 50 AS turn, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(max(value) - min(value), 4) AS span FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", F.floor(F.col("event_id") / 50).alias("turn")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.max("value") - F.min("value"), 4).alias("span"))


@query("AG20_string_rollup", "SELECT c_nationkey, string_agg(c_name, '; ' ORDER BY c_name) AS names FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_nationkey").agg(F.concat_ws("; ", F.sort_array(F.collect_list("c_name"))).alias("names"))


@query("AG21_children_by_parent", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderpriority, o_orderkey) AS kids FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("kids"))


@query("AG22_cumulative_usage", "SELECT conv_id, turn, CAST(sum((strlen(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM conversations")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.sum(approx_token_count(F.col("text"))).over(w).alias("total"))


@query("AG23_multi_command", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'forbidden' ELSE 'prompt' END AS decision FROM orders")
def _(t):
    cmds = F.array(F.lit("allow"), F.lit("prompt"), F.when(F.col("o_orderkey") % 3 == 0, "forbidden").otherwise("allow"))
    return t.orders.select("o_orderkey", F.explode(cmds).alias("d")).groupBy("o_orderkey").agg(a.strictest(F.col("d")).alias("decision"))


EDGES_SQL = "SELECT c_custkey AS child, c_custkey // 2 AS parent, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'open' END AS status FROM customer WHERE c_custkey >= 1"


def edges(t):
    return t.customer.where("c_custkey >= 1").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 2).alias("parent"), F.when(F.col("c_acctbal") < 0, "closed").otherwise("open").alias("status"))


@query("GR1_children", f"SELECT child, status FROM ({EDGES_SQL}) WHERE parent = 5 AND status = 'open'")
def _(t):
    return g.children(edges(t), 5, "open").select("child", "status")


@query("GR2_descendants", f"WITH RECURSIVE e AS ({EDGES_SQL}), d AS (SELECT child AS id, 1 AS depth FROM e WHERE parent = 0 AND status = 'open' UNION ALL SELECT e.child, d.depth + 1 FROM e JOIN d ON e.parent = d.id WHERE status = 'open') SELECT id, depth FROM d")
def _(t):
    return g.descendants(edges(t), 0, "open")


@query("GR3_resume_and_close", f"WITH RECURSIVE e AS (SELECT child, parent, CASE WHEN child = 6 THEN 'closed' ELSE status END AS status FROM ({EDGES_SQL})), d AS (SELECT child AS id, 1 AS depth FROM e WHERE parent = 1 AND status = 'open' UNION ALL SELECT e.child, d.depth + 1 FROM e JOIN d ON e.parent = d.id WHERE status = 'open') SELECT id, depth FROM d")
def _(t):
    closed = edges(t).withColumn("status", F.when(F.col("child") == 6, "closed").otherwise(F.col("status")))
    return g.descendants(closed, 1, "open")


@query("TK11_descendant_order", f"WITH RECURSIVE e AS ({EDGES_SQL}), d AS (SELECT child AS id, 1 AS depth FROM e WHERE parent = 0 UNION ALL SELECT e.child, d.depth + 1 FROM e JOIN d ON e.parent = d.id) SELECT id, depth FROM d")
def _(t):
    return g.descendants(edges(t), 0).orderBy("depth", "id")
