"""Row predicates of session listings, logs, hooks and policies, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_or_all(c: Column, wanted: Sequence | None) -> Column:
    """No list or an empty one keeps every row."""
    return c.isin(list(wanted)) if wanted else F.lit(True)


def in_or_none(c: Column, wanted: Sequence | None) -> Column:
    """No list keeps every row; an empty one keeps none."""
    return F.lit(True) if wanted is None else c.isin(list(wanted)) if wanted else F.lit(False)


def provider_matches(provider: Column, wanted: Sequence[str] | None, default: str) -> Column:
    """A missing provider counts as the default one."""
    return in_or_all(F.coalesce(provider, F.lit(default)), wanted)


def thread_filter(df: DataFrame, *, sources=None, providers=None, default_provider="", cwds=None, source_col="source", provider_col="provider", cwd_col="cwd", has_meta="has_meta", has_user="has_user") -> DataFrame:
    """Sessions with a meta record and a user event that pass every filter given."""
    return df.where(
        F.col(has_meta)
        & F.col(has_user)
        & in_or_all(F.col(source_col), sources)
        & provider_matches(F.col(provider_col), providers, default_provider)
        & in_or_none(F.col(cwd_col), cwds)
    )


def normalized_path(path: Column) -> Column:
    """Repeated and trailing separators and '.' parts dropped."""
    p = F.regexp_replace(path, r"(/\.)+(?=/|$)", "")
    p = F.regexp_replace(p, "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")


def levels_from(threshold: str) -> list[str]:
    """The threshold level and those above it."""
    return list(LEVELS[LEVELS.index(threshold.upper()) :])


def log_filter(df: DataFrame, *, threshold=None, since=None, until=None, modules=(), files=(), threads=(), threadless=False, search=None, after_id=None) -> DataFrame:
    """AND across fields, OR inside a list of substrings; threadless rows join those of the threads."""
    tests = []
    if threshold:
        tests.append(F.upper("level").isin(levels_from(threshold)))
    if since is not None:
        tests.append(F.col("ts") >= since)
    if until is not None:
        tests.append(F.col("ts") <= until)
    if modules:
        tests.append(any_of([F.col("module").contains(m) for m in modules]))
    if files:
        tests.append(any_of([F.col("file").contains(m) for m in files]))
    if threads or threadless:
        tests.append(any_of([F.col("thread_id").isin(list(threads))] * bool(threads) + [F.col("thread_id").isNull()] * threadless))
    if search:
        tests.append(F.col("body").contains(search))
    if after_id is not None:
        tests.append(F.col("id") > after_id)
    return df.where(all_of(tests))


def keep_by_policy(df: DataFrame, kind_col: str, policy: dict[str, int], mode: int) -> DataFrame:
    """Rows whose kind has a least mode at or under the given one; kinds without an entry go.

    The policy is a constant of the program, a few dozen kinds.
    """
    least = F.create_map(*[x for k, v in policy.items() for x in (F.lit(k), F.lit(v))])
    return df.where(least[F.col(kind_col)] <= mode)


def without_marked(parts: Column, markers: Sequence[tuple[str, str]]) -> Column:
    """Array elements that are not one whole marked fragment (opened and closed by the same marker)."""
    marked = lambda x: any_of([F.ltrim(F.lower(x)).startswith(a.lower()) & F.rtrim(F.lower(x)).endswith(b.lower()) for a, b in markers])
    return F.filter(parts, lambda x: ~marked(x))


def hook_matches(matcher: Column, name: Column) -> Column:
    """Null, empty and * match all; names with | match exactly; anything else is a regular expression.

    A null name only matches all. An expression that doesn't compile matches nothing; a screen of the syntax
    finds those, for one bad pattern would fail the query.
    """
    plain = matcher.rlike(r"^[A-Za-z0-9_|]+$")
    balanced = (
        (F.length(F.regexp_replace(matcher, r"[^(]", "")) == F.length(F.regexp_replace(matcher, r"[^)]", "")))
        & (F.length(F.regexp_replace(matcher, r"[^\[]", "")) == F.length(F.regexp_replace(matcher, r"[^\]]", "")))
        & ~matcher.rlike(r"^[*+?]|[*+?]{3}|\\$|\(\?|\{")
    )
    pattern = F.when(balanced, matcher).otherwise(F.lit("(?!)"))
    return (
        F.when(matcher.isNull() | matcher.isin("", "*"), True)
        .when(name.isNull(), False)
        .when(plain, F.array_contains(F.split(matcher, r"\|"), name))
        .otherwise(F.regexp_like(name, pattern))
    )


def prefix_rule_matches(cmd: Column, first: Column, rest: Column) -> Column:
    """Whether cmd starts with first and then, token by token, one of each set of alternatives."""
    n = F.size(rest)
    return (F.get(cmd, F.lit(0)) == first) & (F.size(cmd) > n) & F.forall(F.zip_with(F.slice(cmd, F.lit(2), n), rest, lambda c, alt: F.array_contains(alt, c)), lambda ok: ok)


def glob_to_regex(pattern: str) -> str:
    """*.x matches subdomains only, **.x the domain as well, * inside a label."""
    import re

    if pattern == "*":
        return "^.*$"
    if pattern.startswith("**."):
        return rf"^(.+\.)?{re.escape(pattern[3:])}$"
    if pattern.startswith("*."):
        return rf"^.+\.{re.escape(pattern[2:])}$"
    return "^" + re.escape(pattern).replace(r"\*", "[^.]*") + "$"


def host_allowed(host: Column, allow: Sequence[str], deny: Sequence[str]) -> Column:
    """Deny wins over allow."""
    hit = lambda globs: any_of([host.rlike(glob_to_regex(g)) for g in globs])
    return hit(allow) & ~hit(deny)


#: Address blocks that are not public, first address and prefix length.
NON_PUBLIC = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))


def ipv4_number(ip: Column) -> Column:
    part = lambda i: F.split(ip, r"\.")[i].cast("long")
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3))


def is_non_public_ip(ip: Column) -> Column:
    n = ipv4_number(ip)
    tests = []
    for base, bits in NON_PUBLIC:
        a, b, c, d = map(int, base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        tests.append(n.between(low, low + 2 ** (32 - bits) - 1))
    return F.coalesce(any_of(tests), F.lit(False))


def changed_fields(pairs: Sequence[tuple[str, Column, Column]]) -> Column:
    """The names whose two values differ, nulls being equal to each other."""
    return F.filter(F.array(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in pairs]), lambda x: x.isNotNull())
