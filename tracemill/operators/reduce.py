"""Reduction of event logs to entities: threads, turns, calls, conversation items, edges, diffs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship


def entities(events: DataFrame, keys: Sequence[str], kind: str, start: str, end: str, order: str, attributes: Sequence[str] = ()) -> DataFrame:
    """One row an entity: when it began and ended, and what its first event says of it."""
    k, o = F.col(kind), F.col(order)
    return events.where(k.isin(start, end)).groupBy(*keys).agg(
        F.min(F.when(k == start, o)).alias("started"), F.max(F.when(k == end, o)).alias("ended"), *[F.min_by(a, F.when(k == start, o)).alias(a) for a in attributes]
    )


def closed_by_owner(parts: DataFrame, owners: DataFrame, owner_keys: Sequence[str]) -> DataFrame:
    """Parts that never ended end with their owner."""
    o = owners.select(*owner_keys, F.col("ended").alias("_owner_end"))
    return parts.join(o, list(owner_keys), "left").withColumn("cut", F.col("ended").isNull() & F.col("_owner_end").isNotNull()).withColumn("ended", F.coalesce("ended", "_owner_end")).drop("_owner_end")


def crossing(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that more than one owner claims: what a strict replay refuses."""
    return rows.groupBy(key).agg(F.min(owner).alias("a"), F.max(owner).alias("b")).where("a <> b").select(key, "a", "b")


def turns_of(rows: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """Rows numbered by the turn they belong to: 0 before the first opening."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("turn_no", F.count(F.when(opens, 1)).over(w))


def after_last_checkpoint(rows: DataFrame, key: str, order: str, checkpoint: Column) -> DataFrame:
    """What a replay starts from: the last checkpoint and the rows after it, or all."""
    last = F.max(F.when(checkpoint, F.col(order))).over(Window.partitionBy(key))
    return rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(order) >= F.col("_last"))).drop("_last")


def net_diff(changes: DataFrame, keys: Sequence[str], path: str, old: str, new: str, order: str) -> DataFrame:
    """Per path the first old and the last new content; paths that end as they began go."""
    g = changes.groupBy(*keys, path).agg(F.min_by(F.struct(old), order)[old].alias(old), F.max_by(F.struct(new), order)[new].alias(new))
    return g.where(~F.col(old).eqNullSafe(F.col(new)))


def same_reasoning(items: DataFrame, keys: Sequence[str], blob: str, text: str, order: str) -> DataFrame:
    """Items of one encrypted blob are one item: its first place, its first readable text."""
    return items.groupBy(*keys, blob).agg(F.min(order).alias(order), F.min_by(text, F.when(F.col(text).isNotNull(), F.col(order))).alias(text), F.count(F.lit(1)).alias("seen"))


def reconcile_snapshots(snapshots: DataFrame, group: str, snapshot: str, place: str, content: str) -> DataFrame:
    """Stable ids for the items of growing conversation snapshots.

    Snapshots of a group come in order. An item keeps the id of the item at the same place of the snapshot
    before if contents agree, else of an item of it with this content that is not taken yet; else it is
    new. Ids count per group. Which item is taken depends on those before, so a group is folded in order.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([snapshot, place], kind="stable")
        before: list[tuple[str, int]] = []
        ids, following = [], 0
        for _, one in rows.groupby(snapshot, sort=True):
            contents = one[content].tolist()
            got: list[int | None] = [before[i][1] if i < len(before) and before[i][0] == c else None for i, c in enumerate(contents)]
            taken = {x for x in got if x is not None}
            free: dict[str, list[int]] = {}
            for c, x in before:
                if x not in taken:
                    free.setdefault(c, []).append(x)
            for i, c in enumerate(contents):
                if got[i] is None:
                    if free.get(c):
                        got[i] = free[c].pop(0)
                    else:
                        got[i], following = following, following + 1
            before = list(zip(contents, got, strict=True))
            ids += got
        return rows[[group, snapshot, place]].assign(item_id=ids)

    ship(snapshots.sparkSession)
    t = {f.name: f.dataType.simpleString() for f in snapshots.schema}
    return snapshots.groupBy(group).applyInPandas(fold, f"{group} {t[group]}, {snapshot} {t[snapshot]}, {place} {t[place]}, item_id long")
