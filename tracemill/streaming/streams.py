"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import scratch, ship


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 200, fmt: str = "parquet") -> DataFrame:
    """New files of a folder, at most max_files a batch; the checkpoint is the watermark."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet, and reads that."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start().awaitTermination()


def without_duplicates(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Keeps the state of a key as long as the watermark needs it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def buffered_until_owner(stream: DataFrame, key: str, kind: str, owner: str, value: str) -> DataFrame:
    """Rows that come before their owner wait in state and go out with it; later ones go out at once."""
    ship(stream.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, there = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        for rows in frames:
            there = there or bool((rows[kind] == owner).any())
            held += rows.loc[rows[kind] != owner, value].tolist()
        out = held if there else []
        state.update(([] if there else held, there))
        yield pd.DataFrame({key: [k[0]] * len(out), value: out})

    schema = f"{key} {types[key]}, {value} {types[value]}"
    return stream.groupBy(key).applyInPandasWithState(run, schema, f"held array<{types[value]}>, there boolean", "append", "NoTimeout")


def throttled_sets(stream: DataFrame, key: str, at: str, every: timedelta, item: str) -> DataFrame:
    """key, at, items: the first change goes out at once, later ones together, `every` after what went out before.

    A set goes out at a moment that the times of changes decide: when it may, or with the next change after that.
    What waits is given out with each batch as far as it is known, for drain_latest(): so the end of the input needs
    no timer, and a change that comes late is in the newest set. State is what went out last and what waits.
    """
    ship(stream.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sent, went, waits = state.get if state.exists else (None, [], [])
        now, waits = (None, set()) if sent is None else (pd.Timestamp(sent), set(waits))
        went, out = set(went), {}
        rows = pd.concat([f[[at, item]] for f in frames]).dropna(subset=[at]).drop_duplicates().sort_values(at, kind="stable")
        for t, changes in rows.groupby(at, sort=True)[item]:
            changes = set(changes.dropna())
            if waits and t > now + every:
                now, went, waits = now + every, waits, set()
                out[now] = went
            if now is None or (t >= now + every and not waits):
                now, went = t, changes
                out[now] = went
            elif t <= now:
                went |= changes
                out[now] = went
            else:
                waits |= changes
        if waits:
            out[now + every] = waits
        if now is not None:
            state.update((now.to_pydatetime(), sorted(went), sorted(waits)))
        yield pd.DataFrame({key: [k[0]] * len(out), at: pd.Series(list(out), dtype="datetime64[ns]"), "items": [sorted(v) for v in out.values()]})

    schema = f"{key} {types[key]}, {at} {types[at]}, items array<{types[item]}>"
    return stream.groupBy(key).applyInPandasWithState(run, schema, f"sent {types[at]}, went array<{types[item]}>, waits array<{types[item]}>", "update", "NoTimeout")


def drain_latest(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation over all that is there: each batch writes the rows it changed, the last of a key counts."""
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start().awaitTermination()
    rows = stream.sparkSession.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *[F.col(f"_last.{c}") for c in rest])


def staged(df: DataFrame, label: str, files: int = 4) -> str:
    """A folder of files that a stream can take in."""
    path = scratch(df.sparkSession, label)
    df.repartition(files).write.parquet(path)
    return path


# --- parsers of text that comes in chunks, with state from chunk to chunk

Pieces = list[tuple[str, str]]


def tags(open_: str, close: str) -> Callable[[str, str, bool], tuple[str, Pieces]]:
    """A parser that tells text in tags ("hidden") from the rest ("shown"), wherever chunks are cut.

    Its state is what is not given out yet: the end of the text that may begin a mark, or all of an open tag's
    text, behind one letter for which of the two. At the end an open tag closes.
    """

    def tail(text: str, mark: str) -> int:
        return next((n for n in range(min(len(text), len(mark) - 1), 0, -1) if text.endswith(mark[:n])), 0)

    def feed(state: str, chunk: str, ended: bool) -> tuple[str, Pieces]:
        inside, text, out = state[:1] == "h", state[1:] + chunk, []
        while (at := text.find(close if inside else open_)) >= 0:
            out.append(("hidden" if inside else "shown", text[:at]))
            text, inside = text[at + len(close if inside else open_) :], not inside
        if ended:
            return "", [*out, ("hidden" if inside else "shown", text)]
        if inside:
            return "h" + text, out
        keep = len(text) - tail(text, open_)
        return "s" + text[keep:], [*out, ("shown", text[:keep])]

    return feed


def hunk_parser(state: str, chunk: str, ended: bool) -> tuple[str, Pieces]:
    """Gives out a patch's hunks, each as soon as the next one begins; the state is the last one so far."""
    text = state + chunk
    at = [m.start() for m in re.finditer("^@@", text, re.M)]
    whole = zip(at, [*at[1:], len(text)] if ended else at[1:], strict=False)
    held = "" if ended else text[at[-1] :] if at else text
    return held, [("hunk", text[a:b]) for a, b in whole]


def parsed(stream: DataFrame, keys: list[str], order: str, chunk: str, last: str, parser: Callable[[str, str, bool], tuple[str, Pieces]]) -> DataFrame:
    """keys, n, kind, piece: what the parser gives out of each text, n counting along it.

    Chunks of a text come in order from batch to batch; `last` marks the one that ends it, and its state goes then.
    """
    ship(stream.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("", 0)
        out, ended = [], False
        for rows in frames:
            rows = rows.sort_values(order)
            for text, ends in zip(rows[chunk], rows[last], strict=True):
                held, pieces = parser(held, text or "", bool(ends))
                out += [(n + i, kind, piece) for i, (kind, piece) in enumerate(pieces)]
                n, ended = n + len(pieces), ended or bool(ends)
        if ended:
            state.remove()
        else:
            state.update((held, n))
        yield pd.DataFrame({**{c: [v] * len(out) for c, v in zip(keys, k, strict=True)}, "n": [x[0] for x in out], "kind": [x[1] for x in out], "piece": [x[2] for x in out]})

    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", n long, kind string, piece string"
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "held string, n long", "append", "NoTimeout")


def staged_in_order(df: DataFrame, label: str, order: str, count: int) -> str:
    """A folder with a file for each value of order from 0 on, in the order in which a stream takes them in."""
    path = scratch(df.sparkSession, label)
    for i in range(count):
        df.where(F.col(order) == i).coalesce(1).write.mode("append").parquet(path)
    return path
