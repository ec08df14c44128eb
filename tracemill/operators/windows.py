"""Ordering, budgets, paging and latest-per-key, as windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], *order: Column, rank="_rn") -> DataFrame:
    """One row a key: the first by order. Ties are for the order to settle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def strictly_increasing(df: DataFrame, keys: Sequence[str], base: str, *order: Column, out="repaired") -> DataFrame:
    """base raised so that it grows by one at least along the order.

    In closed form: with rows numbered, a value is its number plus the largest (base - number) so far.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(w))
    return df.withColumn(out, F.col("_n") + F.max(F.col(base) - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def within_budget(df: DataFrame, keys: Sequence[str], size: Column, order: Sequence[Column], most: int | None, most_rows: int | None = None) -> DataFrame:
    """Rows from the first on while their sizes sum to `most` and they are `most_rows` at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    keep = F.lit(True)
    df = df.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w))
    if most is not None:
        keep &= F.col("_sum") <= most
    if most_rows is not None:
        keep &= F.col("_rn") <= most_rows
    return df.where(keep).drop("_sum", "_rn")


def trimmed_history(df: DataFrame, keys: Sequence[str], size: Column, newest_first: Sequence[Column], cap: int, soft: float = 0.8) -> DataFrame:
    """Over the cap, the newest rows that fit into its soft share; the newest one always stays."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    df = df.withColumn("_all", F.sum(size).over(Window.partitionBy(*keys))).withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w))
    return df.where((F.col("_all") <= cap) | (F.col("_rn") == 1) | (F.col("_sum") <= int(soft * cap))).drop("_all", "_sum", "_rn")


def filled_newest_first(df: DataFrame, keys: Sequence[str], tokens: Column, newest_first: Sequence[Column], budget: int, out="taken") -> DataFrame:
    """Rows that fit a budget from the newest back, and how many tokens of each: the last one is cut."""
    w = Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_t", tokens).withColumn("_before", F.sum(tokens).over(w) - tokens)
    return df.where(F.col("_before") < budget).withColumn(out, F.least(F.col("_t"), budget - F.col("_before"))).drop("_t", "_before")


def head_and_tail(df: DataFrame, keys: Sequence[str], size: Column, order: Sequence[str], head: int, tail: int) -> DataFrame:
    """Rows whose bytes lie in the first `head` or the last `tail` of their stream."""
    upto = lambda o: F.sum(size).over(Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_h", upto([F.col(c) for c in order])).withColumn("_t", upto([F.col(c).desc() for c in order]))
    return df.where((F.col("_h") <= head) | (F.col("_t") <= tail)).drop("_h", "_t")


def before_nth(df: DataFrame, keys: Sequence[str], hit: Column, order: Sequence[Column], n: int) -> DataFrame:
    """Rows before the nth hit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_k", F.count(F.when(hit, 1)).over(w)).where(F.col("_k") < n).drop("_k")


def from_nth_last(df: DataFrame, keys: Sequence[str], hit: Column, order: Sequence[str], n: int) -> DataFrame:
    """Rows from the nth hit from the end on; all where there are fewer."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_k", F.count(F.when(hit, 1)).over(w)).withColumn("_hit", hit)
    return df.where((F.col("_k") < n) | ((F.col("_k") == n) & F.col("_hit"))).drop("_k", "_hit")


def without_last_turns(df: DataFrame, keys: Sequence[str], hit: Column, order: Sequence[str], n: int) -> DataFrame:
    """Rows before the nth hit from the end; where there are fewer, those before the first hit."""
    up = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.count(F.when(hit, 1)).over(Window.partitionBy(*keys))
    df = df.withColumn("_k", F.count(F.when(hit, 1)).over(up)).withColumn("_n", total)
    return df.where(F.col("_k") <= F.greatest(F.col("_n") - n, F.lit(0))).drop("_k", "_n")


def page(df: DataFrame, order: Sequence[Column], n: int, anchor: Column | None = None, offset: int = 0) -> DataFrame:
    """n rows in order, of those the anchor condition keeps."""
    df = df if anchor is None else df.where(anchor)
    return df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)


def bucket_limits(df: DataFrame, bucket: str, rank: Sequence[Column], default: int, special: dict[str, int]) -> DataFrame:
    """The best rows of each bucket; rows without a bucket all stay."""
    limit = F.lit(default)
    for name, n in special.items():
        limit = F.when(F.col(bucket) == name, n).otherwise(limit)
    rn = F.row_number().over(Window.partitionBy(bucket).orderBy(*rank))
    lone, rest = df.where(F.col(bucket).isNull()), df.where(F.col(bucket).isNotNull())
    return rest.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn").unionByName(lone)


# --- folds whose state depends on what they gave out before: one ordered group at a time


def surviving_turns(turns: Column) -> Column:
    """turns: ordered array<struct<ord, pop>>. Places that remain after each pop takes the last `pop`."""
    return F.aggregate(
        turns,
        F.array().cast("array<bigint>"),
        lambda stack, x: F.when(x["pop"] > 0, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - x["pop"], F.lit(0)))).otherwise(F.concat(stack, F.array(x["ord"].cast("bigint")))),
    )


def size_bounded_chunks(sizes: Column, most: int) -> Column:
    """The chunk number of each item when items go into a chunk until it would exceed `most`."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        opens = (a["used"] > 0) & (a["used"] + x > most)
        chunk = a["chunk"] + F.when(opens, 1).otherwise(0)
        return F.struct(F.when(opens, x).otherwise(a["used"] + x).alias("used"), chunk.alias("chunk"), F.concat(a["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])
