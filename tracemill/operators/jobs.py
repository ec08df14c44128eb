"""Jobs of many rows: bounded fan-out, results of row workers, leases."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..cluster import ship

#: How many rows a job works on at once, unless it is asked for less or more, and the most it may.
USUAL, MOST = 16, 64


def concurrency(asked: int | None = None, threads: int | None = None) -> int:
    """What is asked for, from 1 to MOST and to the threads there are."""
    return min(max(asked if asked is not None else USUAL, 1), MOST, max(threads, 1) if threads is not None else MOST)


def fan_out(items: DataFrame, keys: Sequence[str], order: str, took: str, limit: int) -> DataFrame:
    """keys, order, slot, started and ended of each item of a job when `limit` of them run at once.

    Items start in order, each in the slot that is free first. A fold over a job's items, whose state is
    when each slot gets free.
    """
    per = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(took).cast("long").alias("d")))).alias("items"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), limit).alias("free"), F.array().cast("array<struct<slot:int,started:bigint>>").alias("out"))

    def step(a, x):
        at = F.array_min(a["free"])
        slot = F.array_position(a["free"], at).cast("int")
        free = F.transform(a["free"], lambda f, i: F.when(i + 1 == slot, at + x["d"]).otherwise(f))
        return F.struct(free.alias("free"), F.concat(a["out"], F.array(F.struct(slot.alias("slot"), at.alias("started")))).alias("out"))

    got = per.select(*keys, "items", F.aggregate("items", start, step, lambda a: a["out"]).alias("out"))
    each = got.select(*keys, F.explode(F.arrays_zip("items", "out")).alias("x"))
    return each.select(*keys, F.col("x.items.o").alias(order), "x.out.slot", "x.out.started", (F.col("x.out.started") + F.col("x.items.d")).alias("ended"))


def checked_result(result: str | None, fields: dict[str, type]) -> tuple[str | None, bool]:
    """What is wrong with a worker's JSON result, if anything is, and whether it asks to stop the job.

    A result is an object {"result": {...}, "stop": true or false}; its inner object has the fields, of these types.
    """
    try:
        report = json.loads(result or "")
    except ValueError:
        return "no JSON", False
    inner = report.get("result") if isinstance(report, dict) else None
    if not isinstance(inner, dict):
        return "no object", False
    wrong = [k for k, kind in sorted(fields.items()) if not isinstance(inner.get(k), kind) or isinstance(inner.get(k), bool) != (kind is bool)]
    return (f"field {wrong[0]}" if wrong else None), report.get("stop") is True


def row_job(rows: DataFrame, keys: Sequence[str], order: str, task: Column, worker: Callable[[str], str | None], fields: dict[str, type], limit: int) -> DataFrame:
    """keys, order, status, result (JSON) and error of each row of a job.

    Every row's task goes to the worker, which answers with one JSON report. A job works through its rows in waves
    of `limit`; a report that asks to stop lets its wave end, and rows of later waves stay pending.
    """
    ship(rows.sparkSession)

    def run(frames):
        for x in frames:
            got = [worker(t) for t in x["task"]]
            checks = [checked_result(g, fields) for g in got]
            inner = [json.dumps(json.loads(g)["result"], sort_keys=True, separators=(",", ":")) if e is None else None for g, (e, _) in zip(got, checks, strict=True)]
            yield x.assign(result=pd.Series(inner, dtype=object, index=x.index), error=pd.Series([e for e, _ in checks], dtype=object, index=x.index), stop=[s for _, s in checks])

    some = rows.select(*keys, order, task.alias("task"))
    more = [StructField("result", StringType()), StructField("error", StringType()), StructField("stop", BooleanType())]
    reports = some.mapInPandas(run, StructType([*some.schema.fields, *more]))
    wave = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / limit)
    reports = reports.withColumn("wave", wave)
    last = F.min(F.when(F.col("stop"), F.col("wave"))).over(Window.partitionBy(*keys))
    reports = reports.withColumn("ran", F.coalesce(F.col("wave") <= last, F.lit(True)))
    status = F.when(~F.col("ran"), "pending").when(F.col("error").isNull(), "completed").otherwise("failed")
    return reports.select(*keys, order, status.alias("status"), F.when(F.col("ran"), F.col("result")).alias("result"), F.when(F.col("ran"), F.col("error")).alias("error"))


def leases(beats: DataFrame, keys: Sequence[str], second: str, holder: str, lasts: int = 90) -> DataFrame:
    """beats with `held`: the holder that each heartbeat leaves the lease with.

    The holder renews it; anyone else gets it only when it has not been renewed for `lasts` seconds. A fold, as who
    holds it depends on who did.
    """
    per = beats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(second).cast("long").alias("s"), F.col(holder).alias("h")))).alias("bs"))
    kind = beats.schema[holder].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("by"), F.lit(None).cast("long").alias("until"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(a, x):
        takes = a["by"].isNull() | (a["by"] == x["h"]) | (x["s"] >= a["until"])
        by, until = F.when(takes, x["h"]).otherwise(a["by"]), F.when(takes, x["s"] + lasts).otherwise(a["until"])
        return F.struct(by.alias("by"), until.alias("until"), F.concat(a["out"], F.array(by)).alias("out"))

    got = per.select(*keys, "bs", F.aggregate("bs", start, step, lambda a: a["out"]).alias("out"))
    return got.select(*keys, F.explode(F.arrays_zip("bs", "out")).alias("x")).select(*keys, F.col("x.bs.s").alias(second), F.col("x.bs.h").alias(holder), F.col("x.out").alias("held"))


def item_ids(rows: DataFrame, row: str, id_col: str) -> DataFrame:
    """rows with item_id: the id, or row-<row> for a blank one, and the first of -2, -3, ... where that is taken.

    `row` numbers the rows from 1. An id can only meet another of its root, which is what is left without numbers
    at the end. Where a root has one id its repeats are numbered by a window; where it has several, one may be
    another's with a number, and Arrow batches pass through in order, with what is taken as state.
    """
    base = F.when(F.btrim(F.coalesce(id_col, F.lit(""))) == "", F.concat(F.lit("row-"), F.col(row).cast("string"))).otherwise(F.col(id_col))
    keyed = rows.withColumn("_base", base).withColumn("_root", F.regexp_replace("_base", r"(-\d+)+$", ""))
    whole = Window.partitionBy("_root")
    keyed = keyed.withColumn("_mixed", F.min("_base").over(whole) != F.max("_base").over(whole))
    n = F.row_number().over(Window.partitionBy("_root", "_base").orderBy(row))
    alone = keyed.withColumn("_n", n).where(~F.col("_mixed")).withColumn("item_id", F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise("")))

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, taken = None, None
        for batch in batches:
            out = []
            for r, b in zip(batch.column("_root").to_pylist(), batch.column("_base").to_pylist(), strict=True):
                if taken is None or r != root:
                    root, taken = r, Taken()
                out.append(taken.add(b))
            yield batch.select(names).append_column("item_id", pa.array(out, pa.string()))

    ship(rows.sparkSession)
    mixed = keyed.where("_mixed").repartition("_root").sortWithinPartitions("_root", row)
    schema = StructType([*rows.schema.fields, StructField("item_id", StringType())])
    return alone.select(*names, "item_id").unionByName(mixed.mapInArrow(run, schema))


class Taken:
    """Which ids are taken: those that were free, and for every repeated one how far its numbers go."""

    def __init__(self):
        self.free, self.following = set(), {}

    def __contains__(self, name: str) -> bool:
        base, _, k = name.rpartition("-")
        return name in self.free or (k.isascii() and k.isdecimal() and k[0] != "0" and 2 <= int(k) < self.following.get(base, 2))

    def add(self, base: str) -> str:
        if base not in self:
            self.free.add(base)
            return base
        k = self.following.get(base, 2)
        while f"{base}-{k}" in self:
            k += 1
        self.following[base] = k + 1
        return f"{base}-{k}"
