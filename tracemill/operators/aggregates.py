"""Folds and rollups of session logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_where(value: Column, order: Column, keep: Column) -> Column:
    return F.min_by(value, F.when(keep, order))


def last_where(value: Column, order: Column, keep: Column) -> Column:
    return F.max_by(value, F.when(keep, order))


def thread_fold(items: DataFrame, key: str, order: str, role="role", text="text") -> DataFrame:
    """Metadata of a session from its ordered items: first user text, first non-empty title, last role, totals."""
    o, user = F.col(order), F.col(role) == "user"
    return items.groupBy(key).agg(
        first_where(F.col(text), o, user).alias("first_user_text"),
        first_where(F.btrim(F.col(text)), o, user & (F.btrim(F.col(text)) != "")).alias("title"),
        F.max_by(role, o).alias("last_role"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum(F.floor((F.octet_length(text) + 3) / 4)).cast("long").alias("tokens"),
    )


def progress(items: DataFrame, keys: Sequence[str], status: str, names: Sequence[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == n).alias(n) for n in names])


def metric_points(points: DataFrame, name: str, tags: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Counters refuse negative values; histograms count by bucket."""
    v = F.col(value)
    low = [None, *bounds]
    high = [*bounds, None]
    bucket = lambda a, b: F.count_if((F.lit(True) if a is None else v > a) & (F.lit(True) if b is None else v <= b))
    return points.groupBy(name, *tags).agg(
        F.coalesce(F.sum(F.when(v >= 0, v)), F.lit(0.0)).alias("counter"), F.count(value).alias("n"), F.array(*[bucket(a, b) for a, b in zip(low, high, strict=True)]).alias("buckets")
    )


#: Order of policy decisions, mildest first.
DECISIONS = ("allow", "prompt", "forbidden")


def strictest(decision: Column) -> Column:
    rank = F.array_position(F.array(*map(F.lit, DECISIONS)), decision)
    return F.get(F.array(*map(F.lit, DECISIONS)), (F.max(rank) - 1).cast("int"))


def last_decisions(rules: DataFrame, host: str, decision: str, order: str) -> DataFrame:
    """The last decision of each host, prompts not counting, in order of that decision."""
    return rules.where(F.col(decision) != "prompt").groupBy(host).agg(F.max_by(decision, order).alias(decision), F.max(order).alias(order))


def diff_stats(text: Column) -> Column:
    """Added and deleted lines of a unified diff: only lines inside hunks count, whatever they begin with.

    A hunk's header says how many lines it has, so the fold knows where it ends.
    """
    n = lambda line, i: F.coalesce(F.when(F.regexp_extract(line, r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", i) != "", F.regexp_extract(line, r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", i).cast("int")), F.lit(1))
    start = F.struct(*[F.lit(0).alias(k) for k in ("old", "new", "added", "deleted")])

    def step(a, line):
        inside = (a["old"] > 0) | (a["new"] > 0)
        head = ~inside & line.startswith("@@ ")
        plus, minus, note = inside & line.startswith("+"), inside & line.startswith("-"), line.startswith("\\")
        both = inside & ~plus & ~minus & ~note
        return F.struct(
            F.when(head, n(line, 1)).when(minus | both, a["old"] - 1).otherwise(a["old"]).alias("old"),
            F.when(head, n(line, 2)).when(plus | both, a["new"] - 1).otherwise(a["new"]).alias("new"),
            (a["added"] + plus.cast("int")).alias("added"),
            (a["deleted"] + minus.cast("int")).alias("deleted"),
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda a: F.struct(a["added"].alias("added"), a["deleted"].alias("deleted")))
