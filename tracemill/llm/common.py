"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import scratch, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again.

    The copy is made of whole files, so a lost executor costs a re-read and never a re-computation
    that could come out in another order.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracemill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() made once nothing will read it any more."""
    path = getattr(df, "_tracemill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes that a broadcast may take.
MOST_SENT = 32_000_000
_FIXED = {"bigint": 8, "int": 4, "double": 8, "boolean": 1}


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if all its rows take MOST_SENT bytes at most. Columns of fixed width only, so that is certain.

    A row of a hash table has 48 bytes besides its columns: header, pointers and load.
    """
    row = 48 + sum(max(8, _FIXED[f.dataType.simpleString()]) for f in df.schema)
    return F.broadcast(df) if df.count() * row <= MOST_SENT else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """For each name, one like it that no column of df has in any letter case."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def give_back() -> None:
    """Returns a worker's free memory to the system: workers live on, idle, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of a batch that goes to a worker, in place of Spark's 64 MB: long texts come few at a time.
BATCH_BYTES = "8m"
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package at hand on the executors, in small batches unless the session says otherwise."""
    if df.sparkSession.conf.get(_BATCHES, None) in ("67108864b", "64MB"):
        df.sparkSession.conf.set(_BATCHES, BATCH_BYTES)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(tidy, schema)
