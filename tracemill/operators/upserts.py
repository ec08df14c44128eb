"""Tables without updates: commands and versions folded into their current state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """changes replace rows of the same key; of several the one with the largest version."""
    both = table.withColumn("_v", F.lit(None).cast("bigint")).unionByName(changes.withColumn("_v", F.col(version).cast("bigint")).select(*table.columns, "_v"))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_v"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_v")


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(list(keys)).join(table, list(keys), "left_anti").select(table.columns))


def latest_non_null(changes: DataFrame, keys: Sequence[str], cols: Sequence[str], order: str) -> DataFrame:
    """Of each column the last value that was given."""
    return changes.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def filled_from(existing: DataFrame, incoming: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Existing values stay where they aren't null."""
    i = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return existing.join(i, key, "left").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in cols])


def changed_only(existing: DataFrame, incoming: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    e = existing.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return incoming.join(e, key, "left").where(~same).select(key, *cols)


def _commands_run(commands: DataFrame, keys: Sequence[str], order: str, command: str, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """keys, state, accepted, n: n is how many commands there were."""
    step = F.create_map(*[x for (s, c), to in moves.items() for x in (F.lit(f"{s}\t{c}"), F.lit(to))])
    fold = lambda a, x: F.struct(
        F.coalesce(step[F.concat(a["state"], F.lit("\t"), x["c"])], a["state"]).alias("state"),
        (a["accepted"] + F.when(step[F.concat(a["state"], F.lit("\t"), x["c"])].isNotNull(), 1).otherwise(0)).alias("accepted"),
    )
    per = commands.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(command).alias("c")))).alias("cs"))
    got = F.aggregate("cs", F.struct(F.lit(start).alias("state"), F.lit(0).alias("accepted")), fold)
    return per.select(*keys, got.alias("s"), F.size("cs").alias("n")).select(*keys, "s.state", "s.accepted", "n")


def run_state_machine(commands: DataFrame, keys: Sequence[str], order: str, command: str, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """The state of each key after its commands in order, and how many were accepted.

    moves: (state, command) -> state; a command without a move from where the key stands is refused.
    """
    return _commands_run(commands, keys, order, command, moves, start).drop("n")


def refused_commands(commands: DataFrame, keys: Sequence[str], order: str, command: str, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """How many commands of each key run_state_machine() refuses."""
    return _commands_run(commands, keys, order, command, moves, start).select(*keys, (F.col("n") - F.col("accepted")).alias("refused"))


def stored_cells(cells: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], start: Column, cell: Callable[[Column, Column], Column]) -> DataFrame:
    """What each key has stored after its cells in order: cell(stored, row) gives the value that the next cell finds."""
    per = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *cols))).alias("cs"))
    return per.select(*keys, F.aggregate("cs", start, cell).alias("stored"))


def budget_account(usage: DataFrame, keys: Sequence[str], order: Sequence[Column], tokens: str, budget: str) -> DataFrame:
    """Running use, and the status it leads to: budget_limited from where use reaches the budget."""
    used = F.sum(tokens).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return usage.withColumn("used", used).withColumn("status", F.when(F.col(budget).isNotNull() & (F.col("used") >= F.col(budget)), "budget_limited").otherwise("active"))


def backfilled(target: Column, source: Column, has_event: Column) -> Column:
    """The whole source where the target is empty, the row has a user event and the source is not empty."""
    return F.when((target == "") & (has_event == 1) & (source != ""), source).otherwise(target)


def status_update(old: Column, asked: Column, used: Column, budget: Column) -> Column:
    """A limit holds against pausing, and asking for active over budget leaves it limited."""
    over = budget.isNotNull() & (used >= budget)
    return F.when((old == "budget_limited") & (asked == "paused"), old).when((asked == "active") & over, "budget_limited").otherwise(asked)


def merged_layers(entries: DataFrame, path: str, value: str, layer: str) -> DataFrame:
    """entries: one row a leaf. The highest layer wins; a scalar also hides what lower layers have below it."""
    top = entries.groupBy(path).agg(F.max_by(value, layer).alias(value), F.max(layer).alias(layer))
    up = top.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(path, r"\."))), lambda n: F.array_join(F.slice(F.split(path, r"\."), F.lit(1), n), "."))))
    hides = top.select(F.col(path).alias("_up"), F.col(layer).alias("_l"))
    hidden = up.where(F.col("_up") != F.col(path)).join(hides, "_up").where(F.col("_l") > F.col(layer)).select(path).distinct()
    # The other way round, a table of a higher layer replaces a lower layer's scalar.
    below = up.where(F.col("_up") != F.col(path)).select(F.col("_up").alias(path), F.col(layer).alias("_l"))
    replaced = top.join(below, path).where(F.col("_l") > F.col(layer)).select(path).distinct()
    return top.join(hidden, path, "left_anti").join(replaced, path, "left_anti").select(path, value)
