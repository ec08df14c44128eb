"""Matching rows of two sides: calls with outputs, starts with ends, names, paths, merged directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import latest_by


def with_name(rows: DataFrame, primary: DataFrame, legacy: DataFrame, key: str, out="name") -> DataFrame:
    """primary and legacy have (key, name), one row a key; legacy serves where primary has none."""
    p, q = primary.select(key, F.col("name").alias("_p")), legacy.select(key, F.col("name").alias("_l"))
    return rows.join(p, key, "left").join(q, key, "left").withColumn(out, F.coalesce("_p", "_l")).drop("_p", "_l")


def with_aborted_outputs(items: DataFrame, keys: Sequence[str], ord_col="ord", kind="kind", call="call_id") -> DataFrame:
    """Each call without an output gets one that says so, right after it; sub orders the two."""
    calls = items.where(F.col(kind) == "call")
    outputs = items.where(F.col(kind) == "output").select(*keys, call).distinct()
    made = calls.join(outputs, [*keys, call], "left_anti").select(*keys, ord_col, F.lit("output").alias(kind), call, F.lit("aborted").alias("body"), F.lit(1).alias("sub"))
    return items.select(*keys, ord_col, kind, call, "body", F.lit(0).alias("sub")).unionByName(made)


def without_orphan_outputs(items: DataFrame, keys: Sequence[str], kind="kind", call="call_id") -> DataFrame:
    calls = items.where(F.col(kind) == "call").select(*keys, call).distinct()
    outputs = items.where(F.col(kind) == "output").join(calls, [*keys, call], "left_semi")
    return items.where(F.col(kind) != "output").unionByName(outputs.select(items.columns))


def without_counterparts(items: DataFrame, removed: DataFrame, keys: Sequence[str], call="call_id") -> DataFrame:
    """Items whose call is not among those removed."""
    return items.join(removed.select(*keys, call).distinct(), [*keys, call], "left_anti")


def start_end_pairs(events: DataFrame, keys: Sequence[str], is_start: Column, is_end: Column, at: Column) -> DataFrame:
    """One row a key: first start, last end, status; ends may come before their start."""
    return events.groupBy(*keys).agg(F.min(F.when(is_start, at)).alias("started"), F.max(F.when(is_end, at)).alias("ended")).withColumn(
        "status", F.when(F.col("started").isNull(), "orphan").when(F.col("ended").isNull(), "running").otherwise("done")
    )


def paired_by_order(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ord: str, right_ord: str) -> DataFrame:
    """The nth left row of a key with the nth right one: each right row is used once."""
    n = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(o)))
    return n(left, left_ord).join(n(right, right_ord), [*keys, "_n"], "left").drop("_n")


def merged_directories(base: DataFrame, other: DataFrame, key: str, cols: Sequence[str], labels: str) -> DataFrame:
    """Full outer by key: base wins, its nulls are filled, a name that only repeats the key gives way."""
    a, b = base.select(key, *[F.col(c).alias(f"a_{c}") for c in [*cols, "name", labels]]), other.select(key, *[F.col(c).alias(f"b_{c}") for c in [*cols, "name", labels]])
    j = a.join(b, key, "full_outer")
    name = F.when(F.col("a_name").isNull() | (F.col("a_name") == F.col(key)), F.coalesce("b_name", "a_name")).otherwise(F.col("a_name"))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce(f"a_{labels}", none), F.coalesce(f"b_{labels}", none))))
    return j.select(key, name.alias("name"), both.alias(labels), *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in cols])


def deepest_root(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Each path with the longest root it lies under.

    Every prefix of a path is looked up by equality, so the roots may be of any number.
    """
    parts = F.split(F.col(path), "/")
    up = F.explode_outer(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    keyed = paths.withColumn("_prefix", up)
    hit = keyed.join(roots.select(F.col(root).alias("_prefix"), F.lit(True).alias("_hit")), "_prefix", "left")
    return hit.groupBy(*paths.columns).agg(F.max_by("_prefix", F.when(F.col("_hit"), F.length("_prefix"))).alias("_best"), F.max("_hit").alias("_any")).withColumn(root, F.when(F.col("_any"), F.col("_best"))).drop("_best", "_any")


def workspace_diff(before: DataFrame, after: DataFrame, path="path", digest="digest") -> DataFrame:
    j = before.select(path, F.col(digest).alias("_a")).join(after.select(path, F.col(digest).alias("_b")), path, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified")
    return j.select(path, change.alias("change")).where(F.col("change").isNotNull())


def rule_for(commands: DataFrame, rules: DataFrame, program: str) -> DataFrame:
    """rules: (name, decision). The rule of the whole program path, else of its last part, else a guess."""
    exact = rules.select(F.col("name").alias(program), F.col("decision").alias("_exact"))
    base = rules.select(F.col("name").alias("_base"), F.col("decision").alias("_by_base"))
    j = commands.join(exact, program, "left").withColumn("_base", F.substring_index(program, "/", -1)).join(base, "_base", "left")
    return j.withColumn("decision", F.coalesce("_exact", "_by_base", F.lit("prompt"))).drop("_exact", "_base", "_by_base")


def last_of_each(df: DataFrame, ids: DataFrame, key: str, *order: Column) -> DataFrame:
    return latest_by(df.join(ids.select(key).distinct(), key, "left_semi"), [key], *order)
