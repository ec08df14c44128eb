"""SR, RD, TK7, FN21, FN35: search and event-log reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.items import normalized_items
from ..functions.patch import apply_patch
from ..operators import jobs
from ..operators import reduce as r
from ..operators import search as s
from ..operators.windows import latest_by
from .catalog import query

_SCORE = "(length(regexp_extract(lower(url), '(?s)e.*?x.*?n', 0)) - 3)"


@query("SR1_subsequence", f"SELECT page_id, CAST({_SCORE} AS BIGINT) AS score FROM pages WHERE regexp_matches(lower(url), '(?s)e.*x.*n')")
def _(t):
    return t.pages.select("page_id", s.subsequence_score(F.col("url"), "ExN").cast("long").alias("score")).where("score IS NOT NULL")


@query("SR2_fuzzy_paths", f"SELECT url, page_id, CAST({_SCORE} AS INT) AS score FROM pages WHERE regexp_matches(lower(url), '(?s)e.*x.*n') ORDER BY score, url LIMIT 20")
def _(t):
    """The ranked scorer is an outside package; ours is SR1's score."""
    return s.fuzzy_top(t.pages.select("url", "page_id"), "url", "exn", 20).select("url", "page_id", F.col("score").cast("int").alias("score"))


@query("TK7_fuzzy_top", f"SELECT url, CAST({_SCORE} AS INT) AS score FROM pages WHERE regexp_matches(lower(url), '(?s)e.*x.*n') ORDER BY score, url LIMIT 50")
def _(t):
    return s.fuzzy_top(t.pages.select("url"), "url", "exn", 50).select("url", F.col("score").cast("int").alias("score"))


@query("SR3_bm25", """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)') AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
tf AS (SELECT doc_id, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, (SELECT unnest(['the', 'und', 'heother', 'ation']) AS term)), h AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM tf WHERE tf > 0)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h, n GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 25""")
def _(t):
    return s.bm25(t.documents, "doc_id", "text", ["the", "und", "heother", "ation"], 25)


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"


@query("SR4_any_line", f"SELECT doc_id, line, line AS last_line, list_filter([CASE WHEN contains(lower(l), 'the ') THEN 'the ' END, CASE WHEN contains(lower(l), 'und ') THEN 'und ' END], lambda x: x IS NOT NULL) AS matched FROM ({_LINES}) WHERE contains(lower(l), 'the ') OR contains(lower(l), 'und ')")
def _(t):
    return s.matched_lines(t.documents, "doc_id", "text", ["the ", "und "])


@query("SR4_all_on_line", f"SELECT doc_id, line FROM ({_LINES}) WHERE contains(lower(l), 'the ') AND contains(lower(l), ' of ')")
def _(t):
    return s.matched_lines(t.documents, "doc_id", "text", ["the ", " of "], "all_on_same_line").select("doc_id", "line")


@query("SR4_within_lines", f"""WITH h AS (SELECT doc_id, line, contains(lower(l), 'was ') AS a, contains(lower(l), 'for ') AS b FROM ({_LINES})), w AS (SELECT x.doc_id, x.line, min(greatest(CASE WHEN x.a THEN x.line ELSE y.line END, CASE WHEN x.b THEN x.line ELSE y.line END)) AS last_line FROM h x JOIN h y ON x.doc_id = y.doc_id AND y.line BETWEEN x.line AND x.line + 2 WHERE (x.a OR x.b) AND (x.a OR y.a) AND (x.b OR y.b) GROUP BY 1, 2)
SELECT doc_id, line, last_line FROM w o WHERE NOT EXISTS (SELECT 1 FROM w i WHERE i.doc_id = o.doc_id AND i.line > o.line AND i.last_line <= o.last_line)""")
def _(t):
    return s.matched_lines(t.documents, "doc_id", "text", ["was ", "for "], "all_within_lines", 3).select("doc_id", "line", "last_line")


@query("SR5_normalize", "SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", s.normalized(F.col("text"), False, True).alias("n"))


@query("SR6_title_search", "SELECT conv_id FROM conversations WHERE turn = 0 AND text ILIKE '%ther%'")
def _(t):
    return t.conversations.where((F.col("turn") == 0) & F.col("text").ilike("%ther%")).select("conv_id")


@query("SR7_seek_sequence", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS at FROM pages")
def _(t):
    k = F.col("page_id") % 3
    lines = F.when(k == 0, F.array(*map(F.lit, ("x", "a b ", "c")))).when(k == 1, F.array(*map(F.lit, ("c", "a b", "  a b", "“c”")))).otherwise(F.array(F.lit("a b")))
    want = F.when(k == 0, s.line_of_sequence(lines, ["a b", "c"])).when(k == 1, s.line_of_sequence(lines, ["a b", '"c"']))
    return t.pages.select("page_id", want.alias("at"))


THREAD = "user_id % 10"


@query("RD1_dispatch", "SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("RD2_threads", "SELECT user_id, min(event_id) FILTER (WHERE event_type = 'signup') AS started, max(event_id) FILTER (WHERE event_type = 'error') AS ended, min_by(value, event_id) FILTER (WHERE event_type = 'signup') AS value FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1")
def _(t):
    return r.entities(t.events, ["user_id"], "event_type", "signup", "error", "event_id", ["value"])


@query("RD3_cross_thread", "SELECT event_id // 100 AS turn, min(user_id) AS a, max(user_id) AS b FROM events GROUP BY 1 HAVING min(user_id) <> max(user_id)")
def _(t):
    return r.crossing(t.events.select(F.floor(F.col("event_id") / 100).alias("turn"), "user_id"), "turn", "user_id")


_PARTS = "SELECT user_id, event_id % 30 AS k, min(event_id) FILTER (WHERE event_type = 'view') AS started, max(event_id) FILTER (WHERE event_type = 'click') AS ended FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2"


@query("RD4_closed_by_turn", f"SELECT user_id, k, started, coalesce(p.ended, o.ended) AS ended, p.ended IS NULL AND o.ended IS NOT NULL AS cut FROM ({_PARTS}) p LEFT JOIN (SELECT user_id, max(event_id) AS ended FROM events WHERE event_type = 'error' GROUP BY 1) o USING (user_id)")
def _(t):
    e = t.events.withColumn("k", F.col("event_id") % 30)
    parts = r.entities(e, ["user_id", "k"], "event_type", "view", "click", "event_id")
    return r.closed_by_owner(parts, t.events.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("ended")), ["user_id"])


@query("RD5_inference_calls", "SELECT user_id, event_id % 30 AS k, count(*) AS n, round(sum(value), 4) AS usage, list(event_id ORDER BY event_id) AS items FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def _(t):
    e = t.events.where("event_type = 'view'").groupBy("user_id", (F.col("event_id") % 30).alias("k"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("usage"), F.sort_array(F.collect_list("event_id")).alias("items"))


#: A raw item by number of the case, {} the row's number, and what it is: role, channel, kind, call id, parts, error.
_ITEMS = [
    ('{"type":"message","role":"user","content":[{"type":"input_text","text":"t{}"},{"type":"input_image"},{"type":"text"},{"x":1}]}', ("user", None, "message", None, "text::t{};payload_ref:input_image:;payload_ref:content:", None)),
    ('{"type":"message","role":"assistant","phase":"final_answer","content":[]}', ("assistant", "final", "message", None, "payload_ref:empty_content:", None)),
    ('{"type":"message","role":"{}","content":[]}', (None, None, None, None, None, "unknown role {}")),
    ('{"type":"reasoning","content":null,"summary":[{"type":"summary_text","text":"s{}"}],"encrypted_content":"e{}"}', ("assistant", "analysis", "reasoning", None, "summary::s{};encoded:encrypted_content:e{}", None)),
    ('{"type":"reasoning","summary":[]}', (None, None, None, None, None, "nothing in it")),
    ('{"type":"reasoning","content":[{"type":"reasoning_text"}],"id":{}}', (None, None, None, None, None, "content has an entry without text")),
    ('{"type":"function_call","call_id":"c{}","arguments":"{\\"b\\":{},\\"a\\":[1]}"}', ("assistant", "commentary", "function_call", "c{}", 'json::{"a":[1],"b":{}}', None)),
    ('{"type":"function_call","call_id":{},"arguments":"ls {}"}', ("assistant", "commentary", "function_call", None, "text::ls {}", None)),
    ('{"type":"function_call_output","call_id":"c{}","output":[{"type":"output_text","text":"o"}]}', ("tool", "commentary", "function_call_output", "c{}", "text::o", None)),
    ('{"type":"custom_tool_call","call_id":"c{}","name":"exec","input":"f({})"}', ("assistant", "commentary", "custom_tool_call", "c{}", "code:javascript:f({})", None)),
    ('{"type":"mcp_tool_call_output","call_id":"c","z":"' + "z" * 300 + '"}', ("tool", "commentary", "function_call_output", "c", 'json::{"call_id":"c","type":"mcp_tool_call_output","z":"' + "z" * 190 + "...", None)),
    ('{"type":"compaction","encrypted_content":"{}"}', ("assistant", "summary", "message", None, "encoded:encrypted_content:{}", None)),
    ('{"type":"other{}"}', (None, None, None, None, None, "unknown type other{}")),
    ('{"type":', (None, None, None, None, None, "no JSON")),
]


def _sql_text(s: str | None) -> str:
    return "NULL" if s is None else "replace('" + s.replace("'", "''") + "', '{}', CAST(page_id AS VARCHAR))"


def _said(i: int) -> str:
    return f"CASE page_id % {len(_ITEMS)} " + " ".join(f"WHEN {n} THEN {_sql_text(want[i])}" for n, (_, want) in enumerate(_ITEMS)) + " END"


@query("RD6_normalized_items", "SELECT page_id, " + ", ".join(f"{_said(i)} AS {c}" for i, c in enumerate(("role", "channel", "kind", "call_id", "parts", "error"))) + " FROM pages")
def _(t):
    n = F.col("page_id")
    raw = F.get(F.array(*[F.lit(item) for item, _ in _ITEMS]), (n % len(_ITEMS)).cast("int"))
    got = normalized_items(t.pages.select("page_id", F.replace(raw, F.lit("{}"), n.cast("string")).alias("item")), "item")
    shown = F.transform("parts", lambda p: F.concat(p["kind"], F.lit(":"), F.coalesce(p["label"], F.lit("")), F.lit(":"), F.coalesce(p["text"], F.lit(""))))
    return got.select("page_id", "role", "channel", "kind", "call_id", F.array_join(shown, ";").alias("parts"), "error")


@query("RD6_reconcile_items")
def _(t):
    """Each conversation's prefixes are its snapshots; every third one is rewritten at its start."""
    c = t.conversations.select("conv_id", "turn", "text")
    snap = c.select(F.col("conv_id").alias("c"), F.col("turn").alias("snapshot")).join(c.withColumnRenamed("conv_id", "c"), "c").where("turn <= snapshot")
    return r.reconcile_snapshots(snap.select("c", "snapshot", "turn", F.when((F.col("snapshot") % 3 == 2) & (F.col("turn") == 0), "rewritten").otherwise(F.col("text")).alias("content")), "c", "snapshot", "turn", "content")


@query("RD7_reasoning_identity", "SELECT user_id, event_id % 25 AS blob, min(event_id) AS event_id, min_by(event_type, event_id) FILTER (WHERE event_type <> 'view') AS text, count(*) AS seen FROM events GROUP BY 1, 2")
def _(t):
    i = t.events.select("user_id", (F.col("event_id") % 25).alias("blob"), "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("text"))
    return r.same_reasoning(i, ["user_id"], "blob", "text", "event_id")


_CK = "WITH l AS (SELECT *, max(event_id) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id) AS last FROM events)"


@query("RD8_compaction", f"{_CK} SELECT user_id, event_id FROM l WHERE last IS NULL OR event_id >= last")
def _(t):
    return r.after_last_checkpoint(t.events, "user_id", "event_id", F.col("event_type") == "signup").select("user_id", "event_id")


@query("RD9_tool_calls", f"SELECT user_id, k, started, ended, CAST(ended - started AS BIGINT) AS took FROM ({_PARTS}) WHERE started IS NOT NULL")
def _(t):
    e = r.entities(t.events.withColumn("k", F.col("event_id") % 30), ["user_id", "k"], "event_type", "view", "click", "event_id")
    return e.where("started IS NOT NULL").withColumn("took", F.col("ended") - F.col("started"))


@query("RD10_terminal_sessions", "SELECT user_id, event_id % 30 AS k, count(*) AS operations, max_by(event_type, event_id) AS last FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2")
def _(t):
    e = t.events.where(F.col("event_type").isin("click", "error")).groupBy("user_id", (F.col("event_id") % 30).alias("k"))
    return e.agg(F.count(F.lit(1)).alias("operations"), F.max_by("event_type", "event_id").alias("last"))


@query("RD11_code_cells", f"SELECT user_id, k, started, ended, ended < started AS early FROM ({_PARTS}) WHERE started IS NOT NULL AND ended IS NOT NULL")
def _(t):
    """Ends may come before their start; in a batch their order does not matter."""
    e = r.entities(t.events.withColumn("k", F.col("event_id") % 30), ["user_id", "k"], "event_type", "view", "click", "event_id")
    return e.where("started IS NOT NULL AND ended IS NOT NULL").withColumn("early", F.col("ended") < F.col("started"))


@query("RD12_interaction_edges", "WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS n, event_id % 5 AS c FROM events WHERE event_type = 'view'), q AS (SELECT user_id, event_id AS item, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS n, event_id % 5 AS c FROM events WHERE event_type = 'click') SELECT event_id, coalesce(CAST(item AS VARCHAR), 'thread-' || l.user_id) AS target FROM l LEFT JOIN q ON l.user_id = q.user_id AND l.n = q.n AND l.c = q.c")
def _(t):
    from ..operators.joins import paired_by_order

    e = t.events.withColumn("c", F.col("event_id") % 5)
    edges, found = e.where("event_type = 'view'").select("user_id", "c", "event_id"), e.where("event_type = 'click'").select("user_id", "c", F.col("event_id").alias("item"))
    return paired_by_order(edges, found, ["user_id", "c"], "event_id", "item").select("event_id", F.coalesce(F.col("item").cast("string"), F.concat(F.lit("thread-"), F.col("user_id").cast("string"))).alias("target"))


@query("RD13_history_replay", f"{_CK} SELECT user_id, count(*) AS n, max_by(event_type, event_id) AS latest FROM l WHERE last IS NULL OR event_id >= last GROUP BY 1")
def _(t):
    rows = r.after_last_checkpoint(t.events, "user_id", "event_id", F.col("event_type") == "signup")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", "event_id").alias("latest"))


@query("RD14_net_diff", "SELECT user_id, p, min_by(o, event_id) AS old, max_by(w, event_id) AS new FROM (SELECT user_id, event_id, event_id % 9 AS p, event_type AS o, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE event_type END AS w FROM events) GROUP BY 1, 2 HAVING old IS DISTINCT FROM new")
def _(t):
    c = t.events.select("user_id", "event_id", (F.col("event_id") % 9).alias("p"), F.col("event_type").alias("old"), F.when(F.col("event_id") % 2 == 0, "view").otherwise(F.col("event_type")).alias("new"))
    return r.net_diff(c, ["user_id"], "p", "old", "new", "event_id")


@query("RD15_turn_projection", "SELECT conv_id, k, count(*) AS n, min(turn) AS first FROM (SELECT conv_id, turn, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1, 2")
def _(t):
    return r.turns_of(t.conversations, "conv_id", "turn", F.col("role") == "user").groupBy("conv_id", F.col("turn_no").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))


@query("RD16_fact_join", "SELECT a.event_id AS request, b.event_id AS response FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id = a.event_id + 150 WHERE a.event_type = 'view'")
def _(t):
    b = t.events.select((F.col("event_id") - 150).alias("request"), "user_id", F.col("event_id").alias("response"))
    return t.events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("request")).join(b, ["user_id", "request"]).select("request", "response")


_IDS = "CASE p_partkey % 5 WHEN 0 THEN p_brand || '-2' WHEN 1 THEN '' ELSE p_brand END"


@query("FN21_item_ids", f"""WITH RECURSIVE b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'row-' || p_partkey ELSE {_IDS} END AS base, CASE WHEN p_partkey % 5 = 1 THEN 'row' ELSE p_brand END AS root FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p_partkey) AS i FROM b WHERE root <> 'row'),
f AS (SELECT root, i, base AS item, [base] AS seen FROM o WHERE i = 1 UNION ALL SELECT root, i, item, list_append(seen, item) AS seen FROM (SELECT o.root, o.i, f.seen,
CASE WHEN NOT list_contains(f.seen, o.base) THEN o.base ELSE o.base || '-' || list_min(list_filter(range(2, len(f.seen) + 3), lambda k: NOT list_contains(f.seen, o.base || '-' || k))) END AS item FROM f JOIN o ON o.root = f.root AND o.i = f.i + 1))
SELECT o.p_partkey, f.item FROM f JOIN o USING (root, i) UNION ALL SELECT p_partkey, base FROM b WHERE root = 'row'""")
def _(t):
    """Some ids are another's with a number, some are blank."""
    p = t.part.select("p_partkey", F.expr(_IDS).alias("id"))
    return jobs.item_ids(p, "p_partkey", "id").select("p_partkey", F.col("item_id").alias("item"))


@query("FN35_apply_patch", "SELECT page_id, 'a' || chr(10) || 'B' || page_id || chr(10) || 'c' || chr(10) AS s FROM pages")
def _(t):
    n = F.col("page_id").cast("string")
    return t.pages.select("page_id", apply_patch(F.lit("a\nb\nc\n"), F.concat(F.lit("@@\n a\n-b\n+B"), n, F.lit("\n c\n"))).alias("s"))


@query("SM7_sse_changes", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def _(t):
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.withColumn("b", before).where(~F.col("event_type").eqNullSafe(F.col("b"))).select("event_id", "event_type")


@query("SM12_first_latency", "SELECT user_id, min(event_id) FILTER (WHERE event_type = 'click') - min(event_id) AS waited FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg((F.min(F.when(F.col("event_type") == "click", F.col("event_id"))) - F.min("event_id")).alias("waited"))


@query("SM13_stale_items", "SELECT user_id, CASE WHEN (SELECT max(ts) FROM events) - max(ts) >= INTERVAL 30 MINUTE THEN 'failed' ELSE 'running' END AS status FROM events GROUP BY 1")
def _(t):
    now = t.events.agg(F.max("ts").alias("now"))
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now))
    return last.select("user_id", F.when(F.col("now") - F.col("last") >= F.expr("INTERVAL 30 MINUTES"), "failed").otherwise("running").alias("status"))


@query("SM11_mailbox", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events WHERE event_type = 'purchase'")
def _(t):
    from pyspark.sql import Window

    return t.events.where("event_type = 'purchase'").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("seq"))


@query("SM2_success_watermark", "SELECT user_id, max(event_id) FILTER (WHERE event_type <> 'error') AS mark FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("mark"))


@query("SC7_reverse_scan", "SELECT user_id, max_by(props, event_id) AS props FROM events GROUP BY 1")
def _(t):
    return latest_by(t.events, ["user_id"], F.desc("event_id")).select("user_id", "props")
