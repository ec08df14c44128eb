"""PF: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from .catalog import query

THREADS_SQL = "SELECT conv_id, bool_or(role = 'system') AS has_meta, bool_or(role = 'user') AS has_user, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'p' || (conv_id % 3) END AS provider, 's' || (conv_id % 4) AS source, '/w/' || (conv_id % 5) AS cwd FROM conversations GROUP BY conv_id"


def threads(t):
    g = t.conversations.groupBy("conv_id").agg(F.max(F.col("role") == "system").alias("has_meta"), F.max(F.col("role") == "user").alias("has_user"))
    return g.select(
        "conv_id",
        "has_meta",
        "has_user",
        F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string"))).alias("provider"),
        F.concat(F.lit("s"), (F.col("conv_id") % 4).cast("string")).alias("source"),
        F.concat(F.lit("/w/"), (F.col("conv_id") % 5).cast("string")).alias("cwd"),
    )


@query("PF1_thread_filter", f"SELECT conv_id, source FROM ({THREADS_SQL}) WHERE has_meta AND has_user AND source IN ('s0', 's2') AND coalesce(provider, 'p0') IN ('p0', 'p1')")
def _(t):
    return f.thread_filter(threads(t), sources=["s0", "s2"], providers=["p0", "p1"], default_provider="p0").select("conv_id", "source")


@query("PF2_provider_matcher", f"SELECT conv_id, provider, coalesce(provider, 'p1') IN ('p1') AS hit, true AS hit_all FROM ({THREADS_SQL})")
def _(t):
    p = F.col("provider")
    return threads(t).select("conv_id", "provider", f.provider_matches(p, ["p1"], "p1").alias("hit"), f.provider_matches(p, [], "p1").alias("hit_all"))


@query("PF3_empty_conventions", f"SELECT count(*) AS n_any_provider, 0::BIGINT AS n_empty_cwd, count(*) FILTER (WHERE cwd = '/w/1') AS n_one_cwd FROM ({THREADS_SQL})")
def _(t):
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return threads(t).agg(n(f.in_or_all(F.col("provider"), []), "n_any_provider"), n(f.in_or_none(F.col("cwd"), []), "n_empty_cwd"), n(f.in_or_none(F.col("cwd"), ["/w/1"]), "n_one_cwd"))


@query("PF4_path_equality", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(p, '(/\.)+(/|$)', '\2', 'g'), '/+', '/', 'g'), '(.)/$', '\1') AS path FROM (SELECT page_id, '/' || (page_id % 7) || '//./x' || (page_id % 3) || '/' AS p FROM pages)")
def _(t):
    p = F.concat(F.lit("/"), (F.col("page_id") % 7).cast("string"), F.lit("//./x"), (F.col("page_id") % 3).cast("string"), F.lit("/"))
    return t.pages.select("page_id", f.normalized_path(p).alias("path"))


@query("PF5_source_kinds", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click') AND (event_type <> 'click' OR value > 50)")
def _(t):
    kind = F.col("event_type")
    return t.events.where(kind.isin("view", "click") & ((kind != "click") | (F.col("value") > 50))).select("event_id", "event_type")


@query("PF6_optional_predicates", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 5")
def _(t):
    df = t.orders
    for name, value in {"o_custkey": 7, "o_orderstatus": "O", "o_orderpriority": None}.items():
        df = df if value is None else df.where(F.col(name) == value)
    return df.orderBy("o_orderkey").limit(5).select("o_orderkey", "o_orderstatus")


LOGS_SQL = "SELECT event_id AS id, (epoch_us(ts) // 1000000) AS ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' ELSE 'DEBUG' END AS level, 'mod::' || event_type AS module, 'src/' || (user_id % 5) || '.rs' AS file, CASE WHEN user_id % 10 = 0 THEN NULL ELSE 't' || user_id END AS thread_id, props AS body FROM events"


def logs(t):
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "signup", "INFO").otherwise("DEBUG")
    return t.events.select(
        F.col("event_id").alias("id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        level.alias("level"),
        F.concat(F.lit("mod::"), kind).alias("module"),
        F.concat(F.lit("src/"), (F.col("user_id") % 5).cast("string"), F.lit(".rs")).alias("file"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("thread_id"),
        F.col("props").alias("body"),
    )


@query("PF7_log_filter", f"SELECT id, level, thread_id FROM ({LOGS_SQL}) WHERE level IN ('WARN', 'ERROR') AND (contains(module, 'error') OR contains(module, 'purch')) AND contains(file, '1.rs') AND (thread_id IN ('t1', 't11', 't21') OR thread_id IS NULL OR thread_id = 't31') AND contains(body, 'a') AND id > 100")
def _(t):
    return f.log_filter(logs(t), threshold="warn", modules=["error", "purch"], files=["1.rs"], threads=["t1", "t11", "t21", "t31"], threadless=True, search="a", after_id=100).select("id", "level", "thread_id")


@query("PF8_persistence_policy", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'error')")
def _(t):
    return f.keep_by_policy(t.events, "event_type", {"view": 0, "click": 1, "error": 1, "purchase": 2}, 1).select("event_id", "event_type")


@query("PF9_memory_policy", "SELECT conv_id, turn FROM conversations WHERE role NOT IN ('system', 'developer', 'reasoning', 'compaction')")
def _(t):
    return t.conversations.where(~F.col("role").isin("system", "developer", "reasoning", "compaction")).select("conv_id", "turn")


@query("PF10_marked_fragments", """SELECT conv_id, turn, parts FROM (SELECT conv_id, turn, list_filter([CASE WHEN turn % 2 = 0 THEN '<ctx>' || turn || '</ctx>' ELSE 'x' || turn END, CASE WHEN conv_id % 2 = 0 THEN ' <CTX>b</ctx> ' ELSE text END],
  lambda x: NOT (starts_with(ltrim(lower(x)), '<ctx>') AND ends_with(rtrim(lower(x)), '</ctx>'))) AS parts FROM conversations) WHERE len(parts) > 0""")
def _(t):
    n = F.col("turn").cast("string")
    parts = F.array(
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<ctx>"), n, F.lit("</ctx>"))).otherwise(F.concat(F.lit("x"), n)),
        F.when(F.col("conv_id") % 2 == 0, " <CTX>b</ctx> ").otherwise(F.col("text")),
    )
    return t.conversations.select("conv_id", "turn", f.without_marked(parts, [("<ctx>", "</ctx>")]).alias("parts")).where(F.size("parts") > 0)


@query("PF11_metadata_items", "SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase')")
def _(t):
    return t.events.where(F.col("event_type").isin("signup", "purchase")).select("event_id")


@query("PF12_hook_matcher", r"""SELECT m.id, n.event_type, CASE m.id WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN n.event_type IN ('view', 'click') WHEN 3 THEN regexp_matches(n.event_type, '^(s|p).*[eup]$') ELSE false END AS hit
  FROM (SELECT unnest([0, 1, 2, 3, 4]) AS id) m, (SELECT DISTINCT event_type FROM events) n""")
def _(t):
    m = t.spark.createDataFrame([(0, None), (1, "*"), (2, "view|click"), (3, "^(s|p).*[eup]$"), (4, "(bad")], "id int, matcher string")
    kinds = t.events.select("event_type").distinct()
    return kinds.crossJoin(F.broadcast(m)).select("id", "event_type", f.hook_matches(F.col("matcher"), F.col("event_type")).alias("hit"))


@query("PF13_prefix_rule", "SELECT p_partkey, string_split(p_type, ' ')[1] IN ('PROMO', 'SMALL') AND len(string_split(p_type, ' ')) >= 2 AND string_split(p_type, ' ')[1] = 'PROMO' AND string_split(p_type, ' ')[2] IN ('BRUSHED', 'PLATED', 'ANODIZED', 'BURNISHED') AS hit FROM part")
def _(t):
    rest = F.array(F.array(*map(F.lit, ("BRUSHED", "PLATED", "ANODIZED", "BURNISHED"))))
    return t.part.select("p_partkey", F.coalesce(f.prefix_rule_matches(F.split("p_type", " "), F.lit("PROMO"), rest), F.lit(False)).alias("hit"))


@query("PF14_hosts_and_ips", r"""SELECT page_id, (regexp_matches(host, '^.+\.example\.com$') OR regexp_matches(host, '^(.+\.)?example\.net$')) AND NOT regexp_matches(host, '^blog\.[^.]*\.example\.com$') AS allowed,
  page_id % 256 IN (10, 127, 0) OR page_id % 256 >= 224 OR (page_id % 256 = 192 AND page_id % 2 = 0) AS private FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)""")
def _(t):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    ip = F.concat((F.col("page_id") % 256).cast("string"), F.lit(".168.1."), (F.col("page_id") % 200).cast("string"))
    return t.pages.select("page_id", f.host_allowed(host, ["*.example.com", "**.example.net"], ["blog.*.example.com"]).alias("allowed"), f.is_non_public_ip(ip).alias("private"))


@query("PF15_lenient_schema", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '{"type":"string"}' WHEN 1 THEN '{"enum":[' || p_partkey || '],"type":"string"}' WHEN 2 THEN '{"properties":{"a":{"type":"string"},"b":{"enum":[1],"type":"string"}},"type":"object"}'
  WHEN 3 THEN '{"items":{"type":"string"},"type":["array","null"]}' WHEN 4 THEN '{"anyOf":[{"type":"number"},{"properties":{},"type":"object"}]}' END AS lenient FROM part""")
def _(t):
    from ..functions.schema import lenient_schema

    k = F.col("p_partkey")
    n = k.cast("string")
    text = F.when(k % 6 == 0, "true").when(k % 6 == 1, F.concat(F.lit('{"const":'), n, F.lit(', "title": "x"}')))
    text = text.when(k % 6 == 2, '{"properties": {"a": true, "b": {"enum": [1]}}, "$id": "x"}').when(k % 6 == 3, F.concat(F.lit('{"type": ["array", "null", "odd"], "minItems": '), n, F.lit("}")))
    text = text.when(k % 6 == 4, '{"anyOf": [{"minimum": 1}, {"type": "object"}]}').otherwise('{"type": "null"}')
    return t.part.select("p_partkey", lenient_schema(text).alias("lenient"))


@query("PF16_mutating_events", "SELECT event_id FROM events WHERE event_type <> 'view'")
def _(t):
    return t.events.where(F.col("event_type") != "view").select("event_id")


@query("PF17_relevant_kinds", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1")
def _(t):
    return t.events.where(F.col("event_type").isin("signup", "purchase", "error")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("PF18_diff_fields", """SELECT a.o_orderkey, list_filter([CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'status' END, CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'priority' END, CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'customer' END], lambda x: x IS NOT NULL) AS changed
  FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""")
def _(t):
    a, b = t.orders.alias("a"), t.orders.select((F.col("o_orderkey") - 1).alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("c"))
    pairs = [("status", F.col("o_orderstatus"), F.col("s")), ("priority", F.col("o_orderpriority"), F.col("p")), ("customer", F.col("o_custkey"), F.col("c"))]
    return a.join(b, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", f.changed_fields(pairs).alias("changed"))
