"""Session files: JSON-lines logs by date, CSV jobs, prompt history, trace bundles, captured event streams."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import scratch

UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"


def session_name(file_name: Column) -> Column:
    """(ts, id) of session-<time>-<uuid>.jsonl; null for other names."""
    p = rf"^[a-z]+-(\d{{4}}-\d\d-\d\dT\d\d-\d\d-\d\d)-({UUID})\.jsonl$"
    ts = F.try_to_timestamp(F.regexp_extract(file_name, p, 1), F.lit("yyyy-MM-dd'T'HH-mm-ss"))
    return F.when(file_name.rlike(p), F.struct(ts.alias("ts"), F.regexp_extract(file_name, p, 2).alias("id")))


def updated_at(mtime: Column) -> Column:
    """A file's time as records have it: whole milliseconds."""
    return F.date_trunc("millisecond", mtime)


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, mtime (ms), ord, line of every file below path. Line order is a file's own, so a file is read whole."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    meta = raw.select(F.col("_metadata.file_name").alias("file"), updated_at(F.col("_metadata.file_modification_time")).alias("mtime"), "value")
    lines = meta.select("file", "mtime", F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    return lines.where(F.btrim("line") != "")


def read_sessions(spark: SparkSession, path: str, schema: str, newest_first: bool = True) -> DataFrame:
    """One row a record: file name parts, ord and the parsed payload; lines that don't parse have none."""
    lines = read_lines(spark, path).withColumn("name", session_name(F.col("file"))).where("name IS NOT NULL")
    out = lines.select("name.ts", "name.id", "mtime", "ord", F.from_json("line", schema).alias("record"), "line")
    return out.orderBy(F.desc("ts"), F.desc("id"), "ord") if newest_first else out


def parse_errors(records: DataFrame, required: str) -> DataFrame:
    """Records that parse and lines that don't, by session."""
    bad = F.col(f"record.{required}").isNull()
    return records.groupBy("id").agg(F.count_if(~bad).alias("n"), F.count_if(bad).alias("errors"))


def head_summary(records: DataFrame, is_user: Column, head: int = 10, more: int = 200) -> DataFrame:
    """The first `head` records of each session, and up to `more` as far as its first user event."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("ord")
    seen = F.coalesce(F.max(is_user.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    rn = F.row_number().over(w)
    return records.withColumn("_rn", rn).withColumn("_seen", seen).where((F.col("_rn") <= head) | (~F.col("_seen") & (F.col("_rn") <= head + more))).drop("_rn", "_seen")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns text; a header given twice and rows of another width are errors; empty rows go."""
    first = spark.read.text(path).limit(1).collect()
    names = next(iter(spark.read.option("header", False).csv(spark.sparkContext.parallelize([r.value.lstrip("﻿") for r in first])).collect()), [])
    twice = {n for n in names if list(names).count(n) > 1}
    if twice:
        raise ValueError(f"csv header {sorted(twice)[0]} is duplicated")
    schema = ", ".join(f"`{n}` string" for n in names)
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    empty = F.lit(True)
    for n in names:
        empty &= F.coalesce(F.btrim(F.col(f"`{n}`")), F.lit("")) == ""
    return df.where(~empty)


def csv_cell(c: Column) -> Column:
    """Quoted only where it must be."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def line_at(lines: DataFrame, ord_col: str, offset: int) -> DataFrame:
    return lines.where(F.col(ord_col) == offset)


def write_bundle(events: DataFrame, payloads: DataFrame, path: str) -> None:
    """Payloads first, so that no event names one that isn't there."""
    payloads.write.json(f"{path}/payloads")
    events.write.json(f"{path}/events")


def read_bundle(spark: SparkSession, path: str, event_schema: str, payload_schema: str) -> DataFrame:
    """Events in order with their payloads; a line that doesn't parse fails the read."""
    e = spark.read.schema(event_schema).option("mode", "FAILFAST").json(f"{path}/events")
    return e.join(spark.read.schema(payload_schema).option("mode", "FAILFAST").json(f"{path}/payloads"), "payload_id", "left")


def all_pages(spark: SparkSession, fetch: Callable[[object], tuple[list[tuple], object]], schema: str, held_bytes: int = 4 << 20) -> DataFrame:
    """What a paged source has: fetch(cursor) gives rows and the next cursor, None at the end. With the page's number.

    The driver holds pages of held_bytes and one more; they go to the shared folder together, a file each time.
    """
    path, cursor, page, held, size = scratch(spark, "pages"), None, 0, [], 0
    schema = f"{schema}, page long"
    while True:
        rows, cursor = fetch(cursor)
        held += [(*r, page) for r in rows]
        size += len(pickle.dumps(rows))
        if cursor is None or size >= held_bytes:
            spark.createDataFrame(held, schema).coalesce(1).write.mode("append").parquet(path)
            held, size = [], 0
        if cursor is None:
            return spark.read.schema(schema).parquet(path)
        page += 1


def ordered_pages(rows: DataFrame, by: Sequence[str], n: int, held_rows: int = 50_000) -> Callable[[int | None], tuple[list[tuple], int | None]]:
    """The fetch of a source that gives n rows a page in the order of `by`, nulls last; its cursor is how many it gave.

    Pages asked for in turn come off one sort, of which the driver holds a range of about held_rows; for any other
    cursor rows are sorted anew and those before it passed over.
    """
    order = [F.asc_nulls_last(c) for c in by]
    at, ahead, rest = None, None, None

    def fetch(cursor):
        nonlocal at, ahead, rest
        if rest is None or cursor != at:
            at = cursor or 0
            ranges = rows.repartitionByRange(rows.count() // held_rows + 1, *order).sortWithinPartitions(*order)
            rest = ranges.toLocalIterator()
            ahead = next(islice(rest, at, None), None)
        page = []
        while ahead is not None and len(page) < n:
            page.append(tuple(ahead))
            ahead = next(rest, None)
        at += len(page)
        if ahead is None:  # one row more tells whether another page follows
            rest = None
        return page, None if ahead is None else at

    return fetch


def sse_events(text: Column) -> Column:
    """array<struct<event, data>> of a captured stream: blocks parted by blank lines, data lines joined."""
    blocks = F.filter(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n+"), lambda b: F.btrim(b) != "")
    part = lambda b, key: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith(key + ":")), lambda x: F.ltrim(F.substring(x, len(key) + 2, F.length(x)))), "\n")
    return F.transform(blocks, lambda b: F.struct(part(b, "event").alias("event"), part(b, "data").alias("data")))


def until_completed(events: Column, last: str) -> Column:
    at = F.array_position(F.transform(events, lambda e: e["event"]), last)
    return F.when(at > 0, F.slice(events, F.lit(1), at.cast("int"))).otherwise(events)


def visible_paths(paths: DataFrame, path: str) -> DataFrame:
    """Sorted, without those that have a hidden part."""
    return paths.where(~F.col(path).rlike(r"(^|/)\.[^/.]")).orderBy(path)


def line_range(text: Column, first: int, n: int) -> Column:
    """n lines from `first`, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), F.lit(first), F.lit(n)), "\n")


def event_batches(df: DataFrame, key: Sequence[str], order: str, alone: Column) -> DataFrame:
    """Numbers batches of neighbours; rows that must go alone are a batch each."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order)
    opens = alone | F.coalesce(F.lag(alone).over(w), F.lit(True))
    return df.withColumn("_o", opens.cast("int")).withColumn("batch", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")
