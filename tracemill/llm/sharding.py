"""Sharding by sampled splitters: records range-partitioned by key into shards of near equal bytes.

1. A size-weighted sample of keys: a row is drawn with a chance in proportion to its bytes.
2. Its quantiles are the splitters of key ranges, some for each shard and more where data are large.
3. Rows go to ranges by binary search; ranges that turn out overfull are subdivided by splitters drawn
   from inside them, until none is left that can be divided.
4. Bytes are summed along the ranges, and each row's place in the running total decides its shard.

The key is (hash of the text, hash of the row), so equal texts lie together and a group of copies is
cut only where it is larger than a shard's tolerance. All window work happens inside a range.

Defined results: null text has size 1 and the CRC of no bytes; empty texts likewise; rows that repeat
in every column are told apart by their place in the written table; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_names, table, written

#: Splitters kept in the plan at most; ranges grow in size, not in number, beyond it. A range is one window task:
#: of ten billion rows it has 2.4 million of 40 bytes.
MOST_SPLITTERS = 4095
#: Sampled keys a range, on average; a range then seldom holds twice its share.
OVERSAMPLE = 64


def _range_of(key: Column, splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below key, by binary search over a literal."""
    if not splitters:
        return F.lit(0)
    arr = F.array(*[F.struct(F.lit(a).cast("long").alias("h"), F.lit(b).cast("long").alias("t")) for a, b in splitters])
    steps, n = [], 1
    while n <= len(splitters):
        steps.insert(0, n)
        n *= 2
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(splitters)) & (F.get(arr, at + step - 1) <= key), at + step).otherwise(at),
    )


def _splitters(rows: DataFrame, wanted: int, total: int, seed: int) -> list[tuple[int, int]]:
    """wanted - 1 quantiles of a sample in which a row's chance follows its size.

    The draw is a hash of the row, so a task that runs again draws the same rows. The sample has about
    OVERSAMPLE * wanted keys whatever the table's size.
    """
    chance = F.least(F.lit(1.0), F.col("size") * (OVERSAMPLE * wanted) / F.lit(float(max(total, 1))))
    draw = F.pmod(F.xxhash64("key", "row", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    keys = sorted((r.h, r.t) for r in rows.where(draw < chance).select("key.h", "key.t").toLocalIterator())
    cuts = sorted({keys[len(keys) * i // wanted] for i in range(1, wanted)}) if keys else []
    often = Counter(h for h, _ in cuts)
    # A group of copies is cut inside only if it is heavy enough to hold two splitters.
    return sorted({(h, t if often[h] > 1 or seed else -(1 << 63)) for h, t in cuts})


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col="doc_id", text_col="text", tolerance=0.01, row_col=None) -> DataFrame:
    """id, size, text_crc32, shard, slot, row. Slots count from 0 in each shard, in key order.

    row is row_col, a number of its own for each row, or one that is given here.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        (F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()).alias("row"),
    )
    # Written, for the row numbers must not change afterwards.
    base = written(base.select("doc_id", "size", "text_crc32", "row", F.struct("h", F.xxhash64("doc_id", "row").alias("t")).alias("key")), "shard-rows")
    got = base.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    n, total = got.n, got.b or 0
    wanted = int(min(MOST_SPLITTERS + 1, max(8 * n_shards, n // 200_000)))
    splitters = _splitters(base, wanted, total, 0)
    again = 0
    while True:
        ranged = base.withColumn("range", _range_of(F.col("key"), splitters))
        sizes = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        sizes = {r["range"]: r for r in sizes.collect()}  # a row a range: MOST_SPLITTERS + 1 at most
        over = [r for r in sizes.values() if r.b * wanted > 3 * total and r.lo != r.hi and r.n > 1000]
        room, again, more = MOST_SPLITTERS - len(splitters), again + 1, set()
        for r in over if room >= 2 * len(over) else []:
            inside = ranged.where(F.col("range") == r["range"])
            more.update(_splitters(inside, min(room // len(over), max(2, r.b * wanted // max(total, 1))), r.b, again))
        if not more - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    # Where each range starts, in rows and bytes: as many literals as there are ranges.
    starts, rows, size = [], 0, 0
    for i in range(len(splitters) + 1):
        starts.append((rows, size))
        if i in sizes:
            rows, size = rows + sizes[i].n, size + sizes[i].b
    offset = F.array(*[F.struct(F.lit(a).cast("long").alias("rows"), F.lit(b).cast("long").alias("bytes")) for a, b in starts])
    w = Window.partitionBy("range").orderBy("key", "row")
    placed = ranged.withColumn("before", F.sum("size").over(w) - F.col("size") + F.get(offset, F.col("range"))["bytes"])
    placed = placed.withColumn("at", F.row_number().over(w) - 1 + F.get(offset, F.col("range"))["rows"])
    # A group of copies inside the tolerance goes where its middle lies; a larger one is divided.
    group = Window.partitionBy("range", "key.h")
    first, whole = F.min("before").over(group), F.sum("size").over(group)
    small = whole * n_shards <= F.lit(float(tolerance * total))
    middle = F.when(small, first + whole / 2).otherwise(F.col("before") + F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(float(max(total, 1)))).cast("int")))
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "at", "row"), "shard-placed")
    begins = {r.shard: r.at for r in placed.groupBy("shard").agg(F.min("at").alias("at")).collect()}  # a row a shard
    begin = F.array(*[F.lit(begins.get(i, 0)).cast("long") for i in range(n_shards)])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.get(begin, F.col("shard"))).alias("slot"), "row")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col="doc_id", text_col="text") -> None:
    """Writes the documents themselves, one folder a shard, slots kept as a column.

    The rows are numbered and written first, so a row finds its own place, also where others are just like it.
    Where docs has a column named shard or slot, ours gets an underscore in front.
    """
    shard, slot, row = fresh_names(docs, "shard", "slot", "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "shard-documents")
    place = assign_shards(rows, n_shards, id_col, text_col, row_col=row).select(F.col("row").alias("_at"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = rows.join(place, rows[row] == place["_at"]).select(*[rows[f"`{c}`"] for c in docs.columns], place["_shard"].alias(shard), place["_slot"].alias(slot))
    out.write.partitionBy(shard).parquet(path)
    discard(rows)


def op7(spark, sf_dir):
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
