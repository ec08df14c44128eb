"""Chat formatting: sorted turn structs, adjacent same-role turns merged, one string a conversation.

Template, one block for each run of turns of the same role::

    <|im_start|>ROLE\\nTEXT\\n<|im_sep|>TEXT\\n<|im_end|>\\n

A control string inside a text gets one backslash in front of it. Real marks follow a line feed or
start the string, never a backslash, so taking one backslash away again restores every text. In roles
``%``, line feed and ``<`` are percent-encoded.

Defined results: null text and null role count as empty; rows with equal turn numbers are ordered by
role, then text; repeated rows are repeated turns; null turns come first; rows with a null conv_id form
one conversation of their own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What a text may not show unescaped: our own marks and those of other common chat templates.
CONTROL = r"(<\||</?s>|\[/?INST\]|<</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted string.

    formatted is the segments' texts joined; loss marks what the loss covers. A conversation is one
    output record by definition, so its turns meet in one row and nothing larger does.
    """
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
        ).alias("t"),
    )
    per = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Where each run of one role begins, then the runs themselves.
    per = per.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", F.greatest(i - 1, F.lit(0)))["role"])),
    )
    per = per.select(
        "conv_id",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("ts", s)["role"].alias("role"),
                F.transform(F.slice("ts", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ts")) - s), lambda t: t["text"]).alias("texts"),
            ),
        ).alias("blocks"),
    )
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    block = lambda b: F.flatten(
        F.array(
            F.array(seg(F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n")), F.lit(False))),
            F.flatten(
                F.transform(
                    b["texts"],
                    lambda x, i: F.array(
                        seg(F.when(i == 0, "").otherwise("\n" + SEP), F.lit(False)),
                        seg(escape(x), b["role"] == trained_role),
                    ),
                )
            ),
            F.array(seg(F.lit("\n" + END + "\n"), F.lit(False))),
        )
    )
    return per.select("conv_id", F.flatten(F.transform("blocks", block)).alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>, from the string alone."""
    body = F.regexp_replace(formatted, r"\A<\|im_start\|>", "")
    body = F.regexp_replace(body, r"\n<\|im_end\|>\n\z", "")
    blocks = F.split(body, r"\n<\|im_end\|>\n<\|im_start\|>")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.locate("\n", b) + 1, F.length(b)), r"\n<\|im_sep\|>"),
                lambda t: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    # From a range, for a plan of expressions alone.
    extra = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    out = format_conversations(rows.unionByName(extra))
    out = out.select("conv_id", "segments", "formatted", read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), seen AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '(<\||</?s>|\[/?INST\]|<</?SYS>>)')) AS n_text,
    CASE WHEN opens THEN 25 + length(role) + 2 * len(regexp_extract_all(role, '[%\n<]')) ELSE 11 END AS n_marks
  FROM seen
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + n_marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
