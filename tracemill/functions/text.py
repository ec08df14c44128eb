"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def approx_token_count(s: Column) -> Column:
    """A token for each four bytes begun."""
    return F.floor((F.octet_length(s) + 3) / 4).cast("long")


def byte_prefix(s: Column, n: int) -> Column:
    """At most n bytes, whole characters only."""
    cut = F.substring(s.cast("binary"), 1, n)
    return F.when(F.octet_length(s) <= n, s).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "�+$", ""))


def byte_suffix(s: Column, n: int) -> Column:
    cut = F.substring(s.cast("binary"), F.octet_length(s) - n + 1, F.lit(n))
    return F.when(F.octet_length(s) <= n, s).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "^�+", ""))


def truncate_middle(s: Column, max_bytes: int, in_tokens: bool = False) -> Column:
    """Half of the budget from each end, with a note of what is gone between."""
    left, right = byte_prefix(s, max_bytes // 2), byte_suffix(s, max_bytes - max_bytes // 2)
    gone = F.floor((F.octet_length(s) - max_bytes + 3) / 4) if in_tokens else F.length(s) - F.length(left) - F.length(right)
    note = F.concat(F.lit("…"), gone.cast("long").cast("string"), F.lit(" tokens truncated…" if in_tokens else " chars truncated…"))
    return F.when(F.octet_length(s) <= max_bytes, s).otherwise(F.concat(left, note, right))


def truncated_output(s: Column, max_bytes: int) -> Column:
    lines = F.size(F.split(s, "\n")) - F.when(s.endswith("\n"), 1).otherwise(0)
    return F.when(F.octet_length(s) <= max_bytes, s).otherwise(F.concat(F.lit("Total output lines: "), lines.cast("string"), F.lit("\n\n"), truncate_middle(s, max_bytes)))


def metric_tag(s: Column) -> Column:
    """Letters, digits, ., _, - and /; others become _; 256 characters at most."""
    clean = F.btrim(F.regexp_replace(s, "[^A-Za-z0-9._/-]", "_"), F.lit("_"))
    return F.when((clean == "") | ~clean.rlike("[A-Za-z0-9]"), "unspecified").otherwise(F.left(clean, F.lit(256)))


UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def all_uuids(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"({UUID})"))


def line_suffix(s: Column) -> Column:
    """#L10C2 at the end becomes :10:2, with ranges."""
    s = F.regexp_replace(s, r"#L(\d+)C(\d+)-L(\d+)C(\d+)$", ":$1:$2-$3:$4")
    s = F.regexp_replace(s, r"#L(\d+)-L(\d+)$", ":$1-$2")
    s = F.regexp_replace(s, r"#L(\d+)C(\d+)$", ":$1:$2")
    return F.regexp_replace(s, r"#L(\d+)$", ":$1")


#: What secrets look like, in the order they are replaced.
SECRETS = (
    (r"sk-[A-Za-z0-9]{20,}", "[REDACTED_SECRET]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_SECRET]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}\b", "Bearer [REDACTED_SECRET]"),
    (r"(?i)\b(api[_-]?key|token|secret|password)\b(\s*[:=]\s*)([\"']?)[^\s\"']{8,}", "$1$2$3[REDACTED_SECRET]"),
)


def redact_secrets(s: Column) -> Column:
    for pattern, to in SECRETS:
        s = F.regexp_replace(s, pattern, to)
    return s


def fingerprint(domain: str, s: Column) -> Column:
    """SHA-1 of a domain, a zero byte and the text."""
    return F.sha1(F.concat(F.lit(domain).cast("binary"), F.lit(b"\x00"), s.cast("binary")))


def effective_line(s: Column) -> Column:
    """White space collapsed; null for lines of three bytes or fewer and lines without a word character."""
    line = F.btrim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.when((F.octet_length(line) > 3) & line.rlike(r"[\p{L}\p{N}_]"), line)


def diff_path(s: Column) -> Column:
    return F.when(s != "/dev/null", F.regexp_replace(s, "^[ab]/", ""))


def si_suffix(n: Column) -> Column:
    """Three significant figures and K, M or G; plain below 1000, 0 below 0.

    A unit serves up to where its rounded figure would reach 1000.
    """
    n = F.greatest(n, F.lit(0))
    out = n.cast("string")
    for scale, suffix, begins in ((1_000, "K", 1_000), (1_000_000, "M", 999_500), (1_000_000_000, "G", 999_500_000)):
        x = n / scale
        digits = lambda d: F.format_string(f"%.{d}f", F.round(x * 10**d) / 10**d)  # noqa: B023, E731
        shown = F.when(F.round(100 * x) < 1000, digits(2)).when(F.round(10 * x) < 1000, digits(1)).otherwise(digits(0))
        out = F.when(n >= begins, F.concat(shown, F.lit(suffix))).otherwise(out)
    return out


def with_separators(n: Column) -> Column:
    return F.format_number(n, 0)


def elapsed(ms: Column) -> Column:
    """ms below a second, seconds below a minute, then minutes and seconds."""
    s, cents = F.floor(ms / 1000), F.floor((ms + 5) / 10)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s")))
    )


def parse_timestamp(s: Column) -> Column:
    """File-name form first, then RFC 3339."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH-mm-ss")), F.try_to_timestamp(s))


def seconds_or_rfc3339(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.unix_seconds(F.try_to_timestamp(s)))


def strip_prompt_prefix(s: Column, marker: str, placeholder: str = "[Image]") -> Column:
    """What follows the first marker, trimmed; the placeholder for nothing."""
    at = F.locate(marker, s)
    out = F.btrim(F.when(at > 0, F.substring(s, at + len(marker), F.length(s))).otherwise(s))
    return F.when(out == "", placeholder).otherwise(out)


#: Fixed value: digits of short hashes.
BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def short_hash(n: Column, digits: int = 4) -> Column:
    """The last base-62 digits of a number."""
    return F.concat(*[F.substring(F.lit(BASE62), (F.floor(n / 62**i) % 62 + 1).cast("int"), F.lit(1)) for i in range(digits - 1, -1, -1)])


def slug(s: Column, most: int = 60) -> Column:
    """The first characters in lower case, each that is no letter or digit an underscore, none at the end."""
    return F.rtrim(F.lower(F.regexp_replace(F.left(s, F.lit(most)), "[^A-Za-z0-9]", "_")), F.lit("_"))


def render_template(template: str, values: dict[str, Column]) -> Column:
    """{name} takes a value, null as empty; {{ and }} are braces; anything else stays as it stands.

    The template is cut into its pieces once, so what a value holds is never looked at again.
    """
    import re

    parts, end = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}", template):
        parts.append(F.lit(template[end : m.start()]))
        if m[0] in ("{{", "}}"):
            parts.append(F.lit(m[0][0]))
        else:
            parts.append(F.coalesce(values[m[1]].cast("string"), F.lit("")) if m[1] in values else F.lit(m[0]))
        end = m.end()
    return F.concat(*parts, F.lit(template[end:]))


def strict_template(template: str, values: dict[str, Column]) -> Column:
    """{{ name }} takes a value; a name without one, a value without a name or a lone brace is an error."""
    import re

    if re.sub(r"\{\{\s*[A-Za-z_]\w*\s*\}\}", "", template).count("{{") or re.sub(r"\{\{\s*[A-Za-z_]\w*\s*\}\}", "", template).count("}}"):
        raise ValueError("template has an open placeholder")
    parts, end, used = [], 0, set()
    for m in re.finditer(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}", template):
        if m[1] not in values:
            raise ValueError(f"no value for {m[1]}")
        used.add(m[1])
        parts += [F.lit(template[end : m.start()]), values[m[1]].cast("string")]
        end = m.end()
    if missing := set(values) - used:
        raise ValueError(f"no place for {', '.join(sorted(missing))}")
    return F.concat(*parts, F.lit(template[end:]))


def json_cell(v: Column, path: str) -> Column:
    """A JSON value as a CSV cell: text unquoted, null empty, the rest as JSON."""
    return F.coalesce(F.get_json_object(v, path), F.lit(""))


def citation(s: Column) -> Column:
    """path:a-b|note=[...] as a struct, null if it isn't one."""
    p = r"^(.+):(\d+)-(\d+)\|note=\[(.*)\]$"
    g = lambda i: F.regexp_extract(s, p, i)
    return F.when(s.rlike(p), F.struct(g(1).alias("path"), g(2).cast("long").alias("first"), g(3).cast("long").alias("last"), g(4).alias("note")))


def strip_block(s: Column, tag: str) -> Column:
    return F.regexp_replace(s, f"(?s)<{tag}>.*?(</{tag}>|$)", "")


def blocks(s: Column, tag: str) -> Column:
    return F.regexp_extract_all(s, F.lit(f"(?s)<{tag}>(.*?)(?:</{tag}>|$)"), 1)


def canonical_hash(pairs: Column) -> Column:
    """SHA-256 over a map's entries in key order."""
    return F.sha2(F.to_json(F.map_from_entries(F.sort_array(F.map_entries(pairs)))), 256)


def git_blob_oid(data: Column) -> Column:
    data = data.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(data).cast("string").cast("binary"), F.lit(b"\x00"), data))


def estimated_bytes(*cols: Column) -> Column:
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in cols), F.lit(0)).cast("long")


def retry_delay_ms(s: Column) -> Column:
    """From 'try again in 1.5s' or '... 20ms'."""
    p = r"(?i)try again in\s*(\d+(?:\.\d+)?)\s*(ms|seconds|second|s)"
    n, unit = F.regexp_extract(s, p, 1).try_cast("double"), F.lower(F.regexp_extract(s, p, 2))
    return F.when(unit == "ms", F.round(n)).when(n.isNotNull(), F.round(n * 1000)).cast("long")


def normalize_host(s: Column) -> Column:
    """Lower case, without brackets, port and trailing dots."""
    h = F.lower(F.btrim(s))
    h = F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)\]", 1)).when(h.rlike(r"^[^:]*:\d+$"), F.regexp_replace(h, r":\d+$", "")).otherwise(h)
    return F.rtrim(h, F.lit("."))


def canonical_git_url(s: Column) -> Column:
    """host/owner/name for scp-like, ssh and http addresses."""
    u = F.regexp_replace(F.btrim(s), r"^[A-Za-z0-9._-]+@([^:/]+):", "ssh://$1/")
    u = F.regexp_replace(u, r"^[a-z+]+://", "")
    u = F.regexp_replace(u, r"^[^/@]*@", "")
    u = F.regexp_replace(F.regexp_replace(u, "/+$", ""), r"\.git$", "")
    return F.concat(F.regexp_replace(F.lower(F.substring_index(u, "/", 1)), r":\d+$", ""), F.substring(u, F.locate("/", u), F.length(u)))


def rate_limits(headers: Column, prefix: str) -> Column:
    num = lambda k: headers[f"{prefix}-{k}"].try_cast("double")
    return F.struct(num("used-percent").alias("used_percent"), num("window-minutes").cast("long").alias("window_minutes"), num("reset-at").cast("long").alias("reset_at"))


_BLANK = r"(?:[ \t\r\f]|\\\r?\n)"
_BARE = r"[^\s'\"<>{}\[\]()`$|&;\\]|\\\S"
_WORD = rf"(?:(?!#)(?:{_BARE})(?:{_BARE}|\\ )*+)"
_QUOTED = r"""(?:"(?:[^"$`\\]|\\[\s\S])*+"|'[^']*+')"""
_ARGUMENT = rf"(?:{_WORD}|{_QUOTED})++"
#: Words that begin something else than a plain command.
_RESERVED = "!|if|then|else|elif|fi|for|while|until|do|done|case|esac|select|function|declare|typeset|export|readonly|local|unset|unsetenv"
_ENDS = r"(?=[\s;&|]|\\\r?\n|$)"
_NAME = rf"(?!(?:{_RESERVED}|-?\d+){_ENDS})(?![A-Za-z_]\w*\+?=){_WORD}{_ENDS}"
_COMMAND = rf"{_NAME}(?:{_BLANK}++{_ARGUMENT})*+"
_SPACE = rf"(?:{_BLANK}|\n)*+"
_JOINT = rf"{_BLANK}*+(?:&&|\|\||\|(?!&)|;|\n){_SPACE}"
_SCRIPT = rf"^{_SPACE}(?:{_COMMAND}(?:{_JOINT}{_COMMAND})*+{_BLANK}*+;?+{_SPACE})?+$"


def plain_commands(script: Column) -> Column:
    """Word lists of a script that only joins plain commands by &&, ||, ;, | or line ends; null where it does anything else.

    Words may be quoted in whole or in part; what is in quotes stays as it is written. Substitutions, redirections,
    groups, assignments, comments, reserved words and jobs in the background make it not plain.
    """
    tokens = F.regexp_extract_all(script, F.lit(rf"{_ARGUMENT}|\\\r?\n|&&|\|\||[;|\n]"), F.lit(0))
    tokens = F.filter(tokens, lambda t: ~t.rlike(r"^\\\r?\n$"))
    bare = lambda t: F.regexp_replace(t, rf"""\"((?:[^"\\]|\\[\s\S])*+)\"|'([^']*+)'|((?:{_BARE}|\\ )++)""", "$1$2$3")
    joint = lambda t: t.isin("&&", "||", "|", ";", "\n")
    commands = F.aggregate(
        tokens,
        F.array().cast("array<array<string>>"),
        lambda a, t: F.when(joint(t), F.concat(a, F.array(F.array().cast("array<string>")))).otherwise(
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(a, F.size(a) - 1), F.array().cast("array<string>")), F.array(bare(t)))))
        ),
    )
    plain = script.rlike(_SCRIPT) & ~F.exists(tokens, lambda t: t.rlike("^(?:\"\"|''){2,}$"))
    return F.when(plain, F.filter(commands, lambda c: F.size(c) > 0))


def diff_paths(s: Column) -> Column:
    """Paths of a diff's headers, sorted, each once."""
    found = F.regexp_extract_all(s, F.lit(r"(?m)^(?:---|\+\+\+) ([^\t\n]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, diff_path), lambda x: x.isNotNull())))


def path_kind(s: Column, kinds: dict[str, str]) -> Column:
    """The first kind whose mark the path contains."""
    out = F.lit(None).cast("string")
    for mark, kind in reversed(kinds.items()):
        out = F.when(s.contains(mark), kind).otherwise(out)
    return out
