"""FN: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from .catalog import query



@query("FN1_token_count", "SELECT doc_id, (strlen(text) + 3) // 4 AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", x.approx_token_count(F.col("text")).alias("n"))


ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"
def ascii_col():
    return F.regexp_replace("text", r"[^\x00-\x7F]", "")


@query("FN2_truncate_middle", f"SELECT doc_id, CASE WHEN length(a) <= 101 THEN a ELSE left(a, 50) || '…' || (length(a) - 101) || ' chars truncated…' || right(a, 51) END AS s, CASE WHEN length(a) <= 80 THEN a ELSE left(a, 40) || '…' || ((length(a) - 80 + 3) // 4) || ' tokens truncated…' || right(a, 40) END AS s_tokens FROM (SELECT doc_id, {ASCII} AS a FROM documents)")
def _(t):
    return t.documents.select("doc_id", x.truncate_middle(ascii_col(), 101).alias("s"), x.truncate_middle(ascii_col(), 80, True).alias("s_tokens"))


@query("FN3_truncated_output", f"SELECT doc_id, CASE WHEN length(a) <= 200 THEN a ELSE 'Total output lines: ' || (len(string_split(a, chr(10))) - CASE WHEN ends_with(a, chr(10)) THEN 1 ELSE 0 END) || chr(10) || chr(10) || left(a, 100) || '…' || (length(a) - 200) || ' chars truncated…' || right(a, 100) END AS s FROM (SELECT doc_id, {ASCII} AS a FROM documents)")
def _(t):
    return t.documents.select("doc_id", x.truncated_output(ascii_col(), 200).alias("s"))


@query("FN4_byte_prefix", "SELECT doc_id, list_max(list_transform(range(0, 42), lambda n: CASE WHEN strlen(left(text, n)) <= 41 THEN left(text, n) END)) AS s FROM documents")
def _(t):
    return t.documents.select("doc_id", x.byte_prefix(F.col("text"), 41).alias("s"))


@query("FN5_metric_tag", "SELECT doc_id, CASE WHEN NOT regexp_matches(c, '[A-Za-z0-9]') THEN 'unspecified' ELSE left(c, 256) END AS tag FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z0-9._/-]', '_', 'g'), '_') AS c FROM documents)")
def _(t):
    return t.documents.select("doc_id", x.metric_tag(F.col("text")).alias("tag"))


@query("FN6_uuids", f"SELECT conv_id, turn, regexp_extract_all(s, '({x.UUID})') AS ids FROM (SELECT conv_id, turn, text || ' 1234abcd-00' || (conv_id % 10) || '0-4000-8000-0123456789ab. ' || CASE WHEN turn % 2 = 0 THEN '1234ABCD-0000-4000-8000-0123456789AB' ELSE '' END AS s FROM conversations)")
def _(t):
    s = F.concat("text", F.lit(" 1234abcd-00"), (F.col("conv_id") % 10).cast("string"), F.lit("0-4000-8000-0123456789ab. "), F.when(F.col("turn") % 2 == 0, "1234ABCD-0000-4000-8000-0123456789AB").otherwise(""))
    return t.conversations.select("conv_id", "turn", x.all_uuids(s).alias("ids"))


@query("FN7_line_suffix", "SELECT page_id, 'f' || page_id || CASE page_id % 3 WHEN 0 THEN ':' || page_id || ':2' WHEN 1 THEN ':' || page_id || '-9' ELSE ':' || page_id END AS s FROM pages")
def _(t):
    n = F.col("page_id").cast("string")
    tail = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("#L"), n, F.lit("C2"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("#L"), n, F.lit("-L9"))).otherwise(F.concat(F.lit("#L"), n))
    return t.pages.select("page_id", x.line_suffix(F.concat(F.lit("f"), n, tail)).alias("s"))


_REDACT = "text"
for _p, _to in x.SECRETS:
    _flags = "gi" if _p.startswith("(?i)") else "g"
    _REDACT = f"regexp_replace({_REDACT}, '{_p.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}', '{_to.replace('$', chr(92))}', '{_flags}')"


@query("FN8_redact", f"SELECT doc_id, s FROM (SELECT doc_id, {_REDACT} AS s, text FROM documents) WHERE s <> text")
def _(t):
    return t.documents.select("doc_id", x.redact_secrets(F.col("text")).alias("s"), "text").where("s <> text").select("doc_id", "s")


@query("FN9_fingerprint", "SELECT doc_id, sha1(encode('lines.v1') || '\\x00'::BLOB || encode(text)) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", x.fingerprint("lines.v1", F.col("text")).alias("h"))


@query("FN10_effective_line", r"""SELECT doc_id, pos, CASE WHEN strlen(l) > 3 AND regexp_matches(l, '[\p{L}\p{N}_]') THEN l END AS line
FROM (SELECT doc_id, pos, trim(regexp_replace(l, '\s+', ' ', 'g')) AS l FROM (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))""")
def _(t):
    """Every line with its position, the first is 0."""
    lines = t.documents.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "l"))
    return lines.select("doc_id", "pos", x.effective_line(F.col("l")).alias("line"))


@query("FN11_diff_path", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'src/' || page_id END AS p FROM pages")
def _(t):
    s = F.when(F.col("page_id") % 3 == 0, "/dev/null").otherwise(F.concat(F.when(F.col("page_id") % 3 == 1, "a/src/").otherwise("b/src/"), F.col("page_id").cast("string")))
    return t.pages.select("page_id", x.diff_path(s).alias("p"))


def _si(n: str) -> str:
    show = lambda s, u: f"CASE WHEN round(100 * {n} / {s}) < 1000 THEN printf('%.2f{u}', round(100 * {n} / {s}) / 100) WHEN round(10 * {n} / {s}) < 1000 THEN printf('%.1f{u}', round(10 * {n} / {s}) / 10) ELSE printf('%.0f{u}', round({n} / {s})) END"
    return f"CASE WHEN {n} >= 999500 THEN {show('1000000.0::DOUBLE', 'M')} WHEN {n} >= 1000 THEN {show('1000.0::DOUBLE', 'K')} ELSE CAST({n} AS VARCHAR) END"


@query("FN12_si_suffix", f"SELECT doc_id, {_si('n')} AS s, regexp_replace(CAST(n AS VARCHAR), '^$', '') AS plain FROM (SELECT doc_id, doc_id * doc_id + 7 AS n FROM documents)")
def _(t):
    n = F.col("doc_id") * F.col("doc_id") + 7
    return t.documents.select("doc_id", x.si_suffix(n).alias("s"), F.regexp_replace(x.with_separators(n), ",", "").alias("plain"))


@query("FN13_elapsed", "SELECT doc_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ((ms + 5) // 1000) || '.' || lpad(CAST(((ms + 5) // 10) % 100 AS VARCHAR), 2, '0') || 's' ELSE (ms // 60000) || 'm ' || lpad(CAST((ms // 1000) % 60 AS VARCHAR), 2, '0') || 's' END AS s FROM (SELECT doc_id, doc_id * 277 AS ms FROM documents)")
def _(t):
    return t.documents.select("doc_id", x.elapsed(F.col("doc_id") * 277).alias("s"))


@query("FN14_parse_timestamp", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS s FROM orders")
def _(t):
    d = F.col("o_orderdate")
    s = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy-MM-dd'T'HH-mm-ss")).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.orders.select("o_orderkey", F.unix_seconds(x.parse_timestamp(s)).alias("s"))


@query("FN15_seconds_or_rfc3339", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE epoch(o_orderdate)::BIGINT END AS s FROM orders")
def _(t):
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 3
    s = F.when(k == 0, F.unix_seconds(d).cast("string")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return t.orders.select("o_orderkey", x.seconds_or_rfc3339(s).alias("s"))


@query("FN16_strip_prompt", "SELECT conv_id, turn, CASE WHEN turn = 1 THEN '[Image]' ELSE trim(text, chr(32)) END AS s FROM conversations")
def _(t):
    s = F.when(F.col("turn") == 1, F.lit("ctx ## ask:  ")).otherwise(F.concat(F.lit("ctx ## ask: "), "text"))
    return t.conversations.select("conv_id", "turn", x.strip_prompt_prefix(s, "## ask:").alias("s"))


_B62 = " || ".join(f"substr('{x.BASE62}', CAST((n // {62**i}) % 62 AS INT) + 1, 1)" for i in (3, 2, 1, 0))


@query("FN17_slug_hash", f"SELECT doc_id, {_B62} || '-' || rtrim(lower(regexp_replace(left(text, 60), '[^A-Za-z0-9]', '_', 'g')), '_') AS stem FROM (SELECT *, doc_id * 7919 AS n FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.concat(x.short_hash(F.col("doc_id") * 7919), F.lit("-"), x.slug(F.col("text"))).alias("stem"))


@query("FN18_render_template", "SELECT p_partkey, 'Review ' || p_brand || ' of ' || p_size || '. Use {literal} and {missing}.' AS s FROM part")
def _(t):
    return t.part.select("p_partkey", x.render_template("Review {brand} of {size}. Use {{literal}} and {missing}.", {"brand": F.col("p_brand"), "size": F.col("p_size")}).alias("s"))


@query("FN19_strict_template", "SELECT p_partkey, p_brand || '/' || p_type AS s FROM part")
def _(t):
    return t.part.select("p_partkey", x.strict_template("{{ brand }}/{{type}}", {"brand": F.col("p_brand"), "type": F.col("p_type")}).alias("s"))


@query("FN20_json_cell", "SELECT p_partkey, p_brand AS a, CAST(p_size AS VARCHAR) AS b, '' AS c FROM part")
def _(t):
    v = F.to_json(F.struct(F.col("p_brand").alias("a"), F.col("p_size").alias("b")))
    return t.part.select("p_partkey", x.json_cell(v, "$.a").alias("a"), x.json_cell(v, "$.b").alias("b"), x.json_cell(v, "$.c").alias("c"))


@query("FN22_citation", "SELECT page_id, 'a/' || page_id || '.md' AS path, page_id AS first, page_id + 5 AS last, 'why' AS note FROM pages WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 4 = 0")
def _(t):
    n = F.col("page_id")
    s = F.when(n % 4 != 0, F.concat(F.lit("a/"), n.cast("string"), F.lit(".md:"), n.cast("string"), F.lit("-"), (n + 5).cast("string"), F.lit("|note=[why]"))).otherwise("nothing")
    return t.pages.select("page_id", x.citation(s).alias("c")).select("page_id", "c.path", "c.first", "c.last", "c.note")


@query("FN23_marked_blocks", "SELECT conv_id, turn, 'a' || CASE WHEN turn % 2 = 0 THEN 'c' ELSE '' END AS rest, ['x' || turn || CASE WHEN turn % 2 = 0 THEN '' ELSE 'c' END] AS inside FROM conversations")
def _(t):
    s = F.concat(F.lit("a<m>x"), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, "</m>").otherwise(""), F.lit("c"))
    return t.conversations.select("conv_id", "turn", x.strip_block(s, "m").alias("rest"), x.blocks(s, "m").alias("inside"))


@query("FN24_canonical_hash", """SELECT p_partkey, sha256('{"a":"' || p_brand || '","b":"' || p_type || '"}') AS h FROM part""")
def _(t):
    return t.part.select("p_partkey", x.canonical_hash(F.create_map(F.lit("b"), "p_type", F.lit("a"), "p_brand")).alias("h"))


@query("FN25_git_blob", "SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS oid FROM documents")
def _(t):
    return t.documents.select("doc_id", x.git_blob_oid(F.col("text")).alias("oid"))


@query("FN26_estimated_bytes", "SELECT event_id, CAST(strlen(event_type) + coalesce(strlen(props), 0) AS BIGINT) AS n FROM events")
def _(t):
    return t.events.select("event_id", x.estimated_bytes(F.col("event_type"), F.col("props")).alias("n"))


@query("FN27_retry_delay", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id WHEN 1 THEN page_id * 1000 + 500 END AS ms FROM pages")
def _(t):
    n = F.col("page_id")
    s = F.when(n % 3 == 0, F.concat(F.lit("Please try again in "), n.cast("string"), F.lit("ms."))).when(n % 3 == 1, F.concat(F.lit("Try again in "), n.cast("string"), F.lit(".5 seconds."))).otherwise("no")
    return t.pages.select("page_id", x.retry_delay_ms(s).alias("ms"))


@query("FN28_host_normalize", "SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages")
def _(t):
    h = F.regexp_extract("url", "://([^/?#]*)", 1)
    return t.pages.select("page_id", x.normalize_host(F.concat(F.lit(" "), F.upper(h), F.when(F.col("page_id") % 2 == 0, ":443").otherwise("."))).alias("host"))


@query("FN29_sha1", "SELECT doc_id, sha1(text) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha1("text").alias("h"))


@query("FN30_git_url", "SELECT page_id, 'example.com/o/r' || page_id AS u FROM pages")
def _(t):
    n = F.col("page_id").cast("string")
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("git@Example.com:o/r"), n, F.lit(".git"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://user@example.com/o/r"), n, F.lit("/"))).otherwise(F.concat(F.lit("ssh://git@example.com:22/o/r"), n, F.lit(".git")))
    return t.pages.select("page_id", x.canonical_git_url(u).alias("u"))


@query("FN31_rate_limits", "SELECT o_orderkey, CAST(o_orderkey % 100 AS DOUBLE) AS used_percent, CASE WHEN o_orderkey % 2 = 0 THEN 300 END AS window_minutes, CAST(NULL AS BIGINT) AS reset_at FROM orders")
def _(t):
    k = F.col("o_orderkey")
    h = F.create_map(F.lit("x-used-percent"), (k % 100).cast("string"), F.lit("x-window-minutes"), F.when(k % 2 == 0, "300").otherwise("soon"))
    return t.orders.select("o_orderkey", x.rate_limits(h, "x").alias("r")).select("o_orderkey", "r.used_percent", "r.window_minutes", "r.reset_at")


@query("FN32_plain_commands", """SELECT page_id, CASE page_id % 6 WHEN 1 THEN [['ls', '-l'], ['cat', 'f' || page_id]] WHEN 2 THEN [['git', 'log', '-m', 'a b' || chr(10) || page_id], ['wc', '-l']]
WHEN 4 THEN [['rg', '-n', 'x|y;z', '-g*.py' || page_id], ['echo', '']] END AS cmds FROM pages""")
def _(t):
    """Joined commands, quotes with line ends and signs in them, words quoted in part; redirections, assignments and substitutions are refused."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 6
    scripts = ["ls -l > out cat f", "ls -l && cat f", "git log -m 'a b\n{}' | wc -l", "A=1 ls ", "rg -n 'x|y;z' -g\"*.py{}\"\necho \"\";", "echo \"$(pwd)\" "]
    s = F.lit(None).cast("string")
    for i, text in enumerate(scripts):
        head, _, tail = text.partition("{}")
        s = F.when(k == i, F.concat(F.lit(head), n, F.lit(tail))).otherwise(s)
    return t.pages.select("page_id", x.plain_commands(s).alias("cmds"))


@query("FN33_diff_paths", "SELECT page_id, ['new/' || page_id, 'old/' || page_id] AS paths FROM pages")
def _(t):
    n = F.col("page_id").cast("string")
    s = F.concat(F.lit("--- a/old/"), n, F.lit("\n+++ b/new/"), n, F.lit("\n@@ -1 +1 @@\n-x\n+y\n--- /dev/null\n"))
    return t.pages.select("page_id", x.diff_paths(s).alias("paths"))


@query("FN34_path_kind", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '.example.com') THEN 'com' END AS kind FROM pages")
def _(t):
    return t.pages.select("page_id", x.path_kind(F.col("url"), {"/en/": "english", ".example.com": "com"}).alias("kind"))
