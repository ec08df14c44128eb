"""Model items: what a conversation's raw items say, in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import byte_prefix

#: Role, channel and kind of each type of item that says them by its type alone.
TYPES = {
    "reasoning": ("assistant", "analysis", "reasoning"),
    "function_call": ("assistant", "commentary", "function_call"),
    "function_call_output": ("tool", "commentary", "function_call_output"),
    "custom_tool_call": ("assistant", "commentary", "custom_tool_call"),
    "custom_tool_call_output": ("tool", "commentary", "custom_tool_call_output"),
    "tool_search_call": ("assistant", "commentary", "function_call"),
    "web_search_call": ("assistant", "commentary", "function_call"),
    "image_generation_call": ("assistant", "commentary", "function_call"),
    "local_shell_call": ("assistant", "commentary", "function_call"),
    "tool_search_output": ("tool", "commentary", "function_call_output"),
    "mcp_tool_call_output": ("tool", "commentary", "function_call_output"),
    "compaction": ("assistant", "summary", "message"),
    "compaction_summary": ("assistant", "summary", "message"),
    "context_compaction": ("assistant", "summary", "message"),
}
#: Roles of messages, and the channel of each phase.
ROLES = ("system", "developer", "user", "assistant", "tool")
PHASES = {"commentary": "commentary", "final_answer": "final", "summary": "summary"}
COMPACTIONS = ("compaction", "compaction_summary", "context_compaction")
#: Fixed value: bytes that are kept of a JSON value.
MOST_JSON = 240

_PART = "struct<kind:string,label:string,text:string>"


def _part(kind: str, text: Column | None = None, label: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (none if label is None else label).alias("label"), (none if text is None else text).alias("text"))


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    """VOID for a JSON null, null for what isn't there."""
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def _string(v: Column, key: str) -> Column:
    """The text under key, null unless it is one."""
    return F.when(_kind(_at(v, key)) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def _list(v: Column, key: str) -> Column:
    return F.when(F.startswith(_kind(_at(v, key)), F.lit("ARRAY")), F.try_variant_get(v, f"$.{key}", "array<variant>"))


def _json(v: Column) -> Column:
    s = F.to_json(v)
    return _part("json", F.when(F.octet_length(s) > MOST_JSON, F.concat(byte_prefix(s, MOST_JSON), F.lit("..."))).otherwise(s))


def _content(entries: Column) -> Column:
    def one(p):
        kind, text = _string(p, "type"), _string(p, "text")
        is_text = F.coalesce(kind.isin("input_text", "output_text", "text"), F.lit(False))
        return F.when(is_text & text.isNotNull(), _part("text", text)).when(~is_text, _part("payload_ref", label=F.coalesce(kind, F.lit("content"))))

    parts = F.filter(F.transform(entries, one), lambda p: p.isNotNull())
    return F.when(entries.isNull(), F.array(_part("payload_ref", label=F.lit("content")))).when(F.size(parts) == 0, F.array(_part("payload_ref", label=F.lit("empty_content")))).otherwise(parts)


def _reasons(entries: Column, kind: str) -> Column:
    return F.transform(F.coalesce(entries, F.array().cast("array<variant>")), lambda p: _part(kind, _string(p, "text")))


def _refused(v: Column, key: str, types: tuple[str, ...], null_is_none: bool) -> Column:
    """Why a list of a reasoning item isn't one; null if it is, or isn't there."""
    there, entries = _kind(_at(v, key)), _list(v, key)
    said = lambda p: ~F.coalesce(_string(p, "type").isin(*types), F.lit(False))
    none = there.isNull() | ((there == "VOID") if null_is_none else F.lit(False))
    return (
        F.when(none, None)
        .when(entries.isNull(), f"{key} is no list")
        .when(F.exists(entries, said), f"{key} has an entry of another type")
        .when(F.exists(entries, lambda p: _string(p, "text").isNull()), f"{key} has an entry without text")
    )


def normalized_items(rows: DataFrame, item: str) -> DataFrame:
    """rows with role, channel, kind, call_id, parts array<struct<kind, label, text>> and error of the JSON in `item`.

    What a strict replay would stop at has an error that says why, and the rest null. Parts are text, code, json (the
    first MOST_JSON bytes, keys sorted), summary, encoded, or payload_ref for what only the raw payload tells.
    """
    v, type_ = F.col("_v"), F.col("_type")
    names = [F.struct(*[F.lit(x).alias(n) for x, n in zip(t, ("role", "channel", "kind"), strict=True)]) for t in TYPES.values()]
    known = F.create_map(*[x for t, s in zip(TYPES, names, strict=True) for x in (F.lit(t), s)])
    phases = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])
    rows = rows.withColumn("_v", F.try_parse_json(F.col(item))).withColumn("_type", _string(v, "type")).withColumn("_known", known[type_])
    role, encrypted = _string(v, "role"), _kind(_at(v, "encrypted_content"))
    reasons = F.concat(_reasons(_list(v, "content"), "text"), _reasons(_list(v, "summary"), "summary"))
    secret = F.array(_part("encoded", _string(v, "encrypted_content"), F.lit("encrypted_content")))
    message, reasoning = type_ == "message", type_ == "reasoning"
    error = (
        F.when(v.isNull(), "no JSON")
        .when(type_.isNull(), "no type")
        .when(message & role.isNull(), "no role")
        .when(message & ~role.isin(*ROLES), F.concat(F.lit("unknown role "), role))
        .when(~message & F.col("_known").isNull(), F.concat(F.lit("unknown type "), type_))
        .when(type_.isin(*COMPACTIONS) & _string(v, "encrypted_content").isNull(), "no encrypted_content")
        .when(
            reasoning,
            F.coalesce(
                _refused(v, "content", ("reasoning_text", "text"), True),
                _refused(v, "summary", ("summary_text",), False),
                F.when(~encrypted.isin("VOID", "STRING"), "encrypted_content is no text"),
                F.when((F.size(reasons) == 0) & _string(v, "encrypted_content").isNull(), "nothing in it"),
            ),
        )
    )
    arguments, output, typed = _string(v, "arguments"), _string(v, "output"), _string(v, "input")
    said = F.try_parse_json(arguments)
    parts = (
        F.when(message, _content(_list(v, "content")))
        .when(reasoning, F.concat(reasons, F.when(encrypted == "STRING", secret).otherwise(F.array().cast(f"array<{_PART}>"))))
        .when(type_.isin(*COMPACTIONS), secret)
        .when(
            type_ == "function_call",
            F.array(
                F.when(said.isNotNull(), _json(said))
                .when(arguments.isNotNull(), _part("text", arguments))
                .when(_at(v, "arguments").isNotNull(), _json(_at(v, "arguments")))
                .otherwise(_part("payload_ref", label=F.lit("payload")))
            ),
        )
        .when(type_ == "custom_tool_call", F.array(F.when(typed.isNull(), _json(v)).when(_string(v, "name") == "exec", _part("code", typed, F.lit("javascript"))).otherwise(_part("text", typed))))
        .when(
            type_.isin("function_call_output", "custom_tool_call_output"),
            F.when(output.isNotNull(), F.array(_part("text", output)))
            .when(_list(v, "output").isNotNull(), _content(_list(v, "output")))
            .when(_at(v, "output").isNotNull(), F.array(_json(_at(v, "output"))))
            .otherwise(F.array(_part("payload_ref", label=F.lit("tool_output")))),
        )
        .otherwise(F.array(_json(v)))
    )
    has_call = ~message & ~reasoning & ~type_.isin(*COMPACTIONS)
    out = rows.withColumn("error", error)
    fine = lambda c: F.when(F.col("error").isNull(), c)
    out = out.withColumns({
        "role": fine(F.coalesce(F.col("_known.role"), role)),
        "channel": fine(F.when(message, phases[_string(v, "phase")]).otherwise(F.col("_known.channel"))),
        "kind": fine(F.coalesce(F.col("_known.kind"), F.lit("message"))),
        "call_id": fine(F.when(has_call, _string(v, "call_id"))),
        "parts": fine(parts),
    })
    return out.drop("_v", "_type", "_known")
