r"""N-gram Jaccard join by grouped prefixes.

Two documents link when their sets of word shingles have a Jaccard similarity of ``threshold`` percent
or more. Any order of all shingles serves prefix filtering: linked sets share a shingle among each
one's first ``n - ceil(t n) + 1``. The order here is (is it common, hash); which shingles are common
comes from counters over all documents, and errs at no cost but time.

1. Documents with the same set are one variant; variants with the same prefix and size are one group.
2. A posting for each prefix shingle of each group; those nobody shares are dropped.
3. Group pairs are filtered by size and by the number of prefix shingles they share.
4. Pairs that pass are expanded to variants and verified on whole sets.

Before that, a quick first look links most near copies: each variant is verified against a few pivots, one
for each of its BANDS smallest hashes. What that links is contracted to components, and a posting list
then offers all its pairs but those within one component: a list of thousands of near copies is mostly
one component by then and offers little. Lists that still hold several components are dealt into blocks
that are compared two at a time. No link between components is lost.

Defined results: null, empty and wordless texts have empty sets and link with nothing, not even with
each other; fewer words than ``width`` make one shingle; rows with the same id are one node; a null id
is one node of its own, smaller than all others; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, small, table, written
from .components import components
from .shingles import Shingler

#: Counters of the sketch that tells common shingles, and how many of them may be called common.
COUNTERS, MOST_COMMON = 1 << 23, 1 << 18
#: Postings of a list, or of a block of a longer one, that meet in one task.
LONG = 2000
NULL_ID = -(1 << 63)
#: Pivots a variant is compared with at first.
BANDS = 6
#: Rows handled at a time.
SLICE = 1000


def prefix_length(n, t: int):
    return n - (-(-t * n // 100)) + 1


def common_counters(docs: DataFrame, width: int) -> np.ndarray:
    """Flags of the counters whose shingles many documents share.

    Every partition counts all its shingles and reports counters that are high there; a shingle that is
    common anywhere is high in some partition. The report and what is collected are bounded.
    """

    def run(batches):
        s, seen, texts = Shingler(width), np.zeros(COUNTERS, np.int32), set()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(i, SLICE).to_pylist():
                    mark = hash(text)
                    if text and mark not in texts:  # copies say nothing about a shingle
                        if len(texts) < 1_000_000:
                            texts.add(mark)
                        h = s.ordered(text)
                        seen[(h & np.uint64(COUNTERS - 1)).astype(np.int64)] += 1  # one a text, however often it is there
        high = np.flatnonzero(seen >= max(4, 4 * int(seen.mean() + 1)))
        high = high[np.argsort(-seen[high], kind="stable")[:MOST_COMMON]]
        yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(seen[high].astype(np.int64))], names=["counter", "n"])

    high = map_arrow(docs.select("text"), run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    top = high.orderBy(F.desc("n"), "counter").limit(MOST_COMMON).select("counter").toArrow()
    flags = np.zeros(COUNTERS, bool)
    flags[top.column("counter").to_numpy()] = True
    return flags


def prefixes(docs: DataFrame, common: np.ndarray, width: int, t: int) -> DataFrame:
    """id, n, sig, psig, prefix, last, mins of each document; empty sets have an empty prefix.

    last: the place of the prefix's end in the order, as a number; mins: the smallest hash of each of
    BANDS classes of hashes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(common))

    def run(batches):
        s, common = Shingler(width), np.unpackbits(sent.value).view(bool)
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            n, sig, psig, prefix, last, mins = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                h = s.set_of(text)
                late = common[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                p = prefix_length(len(h), t) if len(h) else 0
                first = np.concatenate([h[~late], h[late]])[:p]
                n.append(len(h))
                sig.append(xxhash.xxh3_128_digest(h.tobytes()))
                psig.append(xxhash.xxh3_128_digest(first.tobytes(), seed=len(h)))
                prefix.append(first.view(np.int64))
                last.append(float(late.sum() + p > len(h)) + float(first[-1]) / 2.0**64 if p else 0.0)
                band = h % np.uint64(BANDS)
                mins.append([int(h[np.argmax(band == b)].view(np.int64)) for b in range(BANDS) if (band == b).any()])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(psig, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array(last, pa.float64()), pa.array(mins, pa.list_(pa.int64()))],
                names=["id", "n", "sig", "psig", "prefix", "last", "mins"],
            )

    return map_arrow(docs.select("id", "text"), run, "id long, n long, sig binary, psig binary, prefix array<long>, last double, mins array<long>")


def _lists(batches):
    """Posting lists of a partition sorted by list: numpy columns of whole lists, many at a time."""
    left = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last list may go on
        left = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if left is not None:
        yield left


def _bounds(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def shared(postings: DataFrame) -> DataFrame:
    """The postings of lists with two groups or more; a posting is held back until the next one is seen."""
    names = ["shingle", "n", "gid"]

    def run(batches):
        held, before = None, None  # the last posting, and the shingle of the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(held, cols, strict=True)]
            same = cols[0][1:] == cols[0][:-1]
            keep = np.concatenate([[before is not None and before == cols[0][0]], same])
            keep[:-1] |= same
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep[:-1]]) for c in cols], names=names)
            if len(cols[0]) > 1:
                before = cols[0][-2]
            held = [c[-1] for c in cols]
        if held is not None and before is not None and before == held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in held], names=names)

    return map_arrow(postings.select(*names).repartition("shingle").sortWithinPartitions("shingle"), run, "shingle long, n long, gid long")


def _cells(postings: DataFrame) -> DataFrame:
    """postings, in lists whose pairs are still to be looked at, with the list's number and the posting's block there.

    Lists within one component go. A list longer than LONG is dealt into blocks, and every two blocks make a list of
    their own, so each pair meets in one list and a list has 2 * LONG postings at most. In a list of two blocks only
    pairs across them count; block is -1 where all do.
    """
    lists = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lists = lists.where(f"lo <> hi OR lo = {NULL_ID}").select("shingle", F.ceil(F.col("k") / LONG).cast("int").alias("blocks"))
    rows = postings.join(lists, "shingle").withColumn("own", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("shingle")).otherwise(F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")))
    mixed = F.when(F.col("own") != F.col("other"), F.col("own"))
    # In the list of one block with itself all pairs count; else the own block tells the two apart.
    rows = rows.select(key.alias("list"), "n", "gid", "comp", "last", "shared", "place", "b0", "b1", F.coalesce(mixed, F.lit(-1)).alias("block"))
    return rows.repartition("list").sortWithinPartitions("list", "n", "gid")


def _need(x, y, n: np.ndarray, last: np.ndarray, t: int) -> np.ndarray:
    """How many prefix shingles the sets of postings x and y must share at least to link.

    Shingles shared at or below the lower one of the two prefixes' ends are in both prefixes; the rest is
    at most what the set with that end has beyond its prefix.
    """
    beyond = lambda k: k - prefix_length(k, t)
    rest = np.where(last[x] < last[y], beyond(n[x]), np.where(last[x] > last[y], beyond(n[y]), np.maximum(beyond(n[x]), beyond(n[y]))))
    return -(-t * (n[x] + n[y]) // (100 + t)) - rest


def _distinct(x: np.ndarray, y: np.ndarray, n, gid, last, t: int) -> pa.RecordBatch:
    """Each pair of postings' groups once, with how many shingles it must share."""
    swap = gid[x] > gid[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((gid[y], gid[x]))
    x, y = x[order], y[order]
    new = np.concatenate([[True], (gid[x][1:] != gid[x][:-1]) | (gid[y][1:] != gid[y][:-1])])
    x, y = x[new], y[new]
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (gid[x], gid[y], _need(x, y, n, last, t))], names=["ga", "gb", "need"])


_PAIRS = "ga long, gb long, need long"
_FLUSH = 300_000


def pivot_pairs(variants: DataFrame, central: DataFrame, t: int) -> DataFrame:
    """(a, b): each variant with two pivots of each band it is in; linear many, whatever variants share.

    One pivot is the most central variant, that with the most shared prefix shingles for its size: of
    many near copies the one that differs least from all. The other is drawn by hash.
    """
    rows = variants.join(central, "vid", "left").select("vid", "n", (F.coalesce("shared", F.lit(0)) / F.col("n")).alias("share"), F.explode("mins").alias("band"))
    first = lambda *by: F.min(F.struct(*by, "vid", "n"))
    pivots = rows.groupBy("band").agg(first((-F.col("share")).alias("x")).alias("p"), first(F.xxhash64("vid", "band").alias("x")).alias("q"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pairs = rows.join(pivots, "band").select("vid", "n", F.explode(F.array(F.struct("p.vid", "p.n"), F.struct("q.vid", "q.n"))).alias("pivot"))
    pairs = pairs.where(f"vid <> pivot.vid AND 100 * least(n, pivot.n) >= {t} * greatest(n, pivot.n)")
    return pairs.select(F.least("vid", "pivot.vid").alias("a"), F.greatest("vid", "pivot.vid").alias("b"))


def remaining_pairs(postings: DataFrame, t: int) -> DataFrame:
    """From each list: all pairs of fitting sizes that are not known to be in one component.

    postings: shingle, n, gid, comp, the group's component (NULL_ID where its variants are in several), last, the
    number of the group's postings, the posting's place among them, and two words with a bit for each of
    the group's postings. Two groups that must share `need` of their postings share one of the first
    (number - need + 1) of each; and every bit of one that the other lacks is a posting they don't share.
    """

    def run(batches):
        for key, n, gid, comp, last, have, place, b0, b1, block in _lists(batches):
            b0, b1 = b0.view(np.uint64), b1.view(np.uint64)  # bits of signed numbers are counted without the sign
            b = _bounds(key)
            lone = comp == NULL_ID
            xs, ys, held = [], [], 0
            for lo, hi in zip(b[:-1].tolist(), b[1:].tolist(), strict=True):
                c = comp[lo:hi]
                if hi - lo < 2 or ((c == c[0]).all() and not lone[lo]):
                    continue
                ends = np.searchsorted(n[lo:hi], 100 * n[lo:hi] // t, side="right")
                for k in range(hi - lo - 1):
                    r = np.arange(k + 1, ends[k])
                    r = r[((c[r] != c[k]) | lone[lo + k]) & ((block[lo + r] < 0) | (block[lo + r] != block[lo + k]))] if len(r) else r
                    if len(r):
                        x, y = lo + k, lo + r
                        need, bits = _need(x, y, n, last, t), np.bitwise_count
                        fits = (place[x] <= have[x] - need) & (place[y] <= have[y] - need)
                        fits &= need <= have[x] - bits(b0[x] & ~b0[y]).astype(np.int64) - bits(b1[x] & ~b1[y])
                        fits &= need <= have[y] - bits(b0[y] & ~b0[x]).astype(np.int64) - bits(b1[y] & ~b1[x])
                        r = r[fits]
                    if len(r):
                        xs.append(np.full(len(r), lo + k))
                        ys.append(lo + r)
                        held += len(r)
                    if held > _FLUSH:
                        x, y = np.concatenate(xs), np.concatenate(ys)
                        yield _distinct(x, y, n, gid, last, t)
                        xs, ys, held = [], [], 0
            if held:
                x, y = np.concatenate(xs), np.concatenate(ys)
                yield _distinct(x, y, n, gid, last, t)

    return map_arrow(_cells(postings), run, _PAIRS)


def inner_postings(docs: DataFrame, members: DataFrame, common: np.ndarray, width: int, t: int) -> DataFrame:
    """Postings for pairs inside groups: members (gid, vid, comp) share their prefix and size.

    What two of them must share besides the prefix lies in the rest of their sets, and the prefix principle
    holds there again: a posting for each shingle of the rest's own prefix, in lists of the group.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(common))
    rows = docs.select("id", "text").join(small(members.select(F.col("vid").alias("id"), "gid", "comp")), "id").groupBy("id", "gid", "comp").agg(F.min("text").alias("text"))

    def run(batches):
        s, common = Shingler(width), np.unpackbits(sent.value).view(bool)
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            out = []
            for text in batch.column(3).to_pylist():
                h = s.set_of(text)
                late = common[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                p = prefix_length(len(h), t)
                must = max(1, -(-2 * t * len(h) // (100 + t)) - p)
                out.append((len(h), np.concatenate([h[~late], h[late]])[p : len(h) - must + 1].view(np.int64)))
            k = np.repeat(np.arange(len(out)), [len(x) for _, x in out])
            n = np.array([n for n, _ in out], np.int64)[k]
            cols = [c.take(pa.array(k)) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(np.concatenate([x for _, x in out]))], names=["vid", "gid", "comp", "n", "s"])

    found = map_arrow(rows, run, "vid long, gid long, comp long, n long, s long")
    zero = F.lit(0).cast("long")
    return found.select(F.xxhash64("gid", "s").alias("shingle"), "n", F.col("vid").alias("gid"), "comp", F.lit(0.0).alias("last"), F.lit(1 << 40).alias("shared"), zero.alias("place"), zero.alias("b0"), zero.alias("b1"))


def verified(pairs: DataFrame, docs: DataFrame, width: int, t: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets are similar enough."""
    pairs = written(pairs.select("a", "b").distinct(), "candidates")
    ids = small(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())

    def run(batches):
        s = Shingler(width)
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            sets = [s.set_of(x).view(np.int64) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "set"])

    sets = written(map_arrow(docs.select("id", "text").join(ids, "id", "left_semi"), run, "id long, set array<long>"), "sets")
    a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(a, "a").join(b, "b").where(100 * both >= t * (F.size("sa") + F.size("sb") - both))
    out = written(links.select("a", "b"), "links")
    discard(pairs)
    discard(sets)
    return out


def link_documents(docs: DataFrame, id_col="doc_id", text_col="text", width=5, threshold=80) -> DataFrame:
    """id, n_shingles, component_id for every row of docs."""
    t = threshold
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    common = common_counters(docs, width)
    sets = written(prefixes(docs, common, width, t), "prefixes")
    # A variant has one set; a group has variants of one prefix and size. Each is named by its smallest id.
    some = sets.where("n > 0")
    variants = some.groupBy("sig", "n").agg(F.min("id").alias("vid"), F.min("psig").alias("psig"), F.min("last").alias("last"), F.min("mins").alias("mins"))
    variants = written(variants, "variants")
    groups = variants.groupBy("psig", "n").agg(F.min("vid").alias("gid"), F.count(F.lit(1)).alias("k"))
    members = written(variants.join(groups, ["psig", "n"]).select("gid", "vid", "k", "last"), "members")
    heads = members.where("gid = vid").select("gid").distinct()
    postings = some.join(heads, some["id"] == heads["gid"]).select(F.explode("prefix").alias("shingle"), "n", "gid")
    postings = written(shared(postings), "postings")

    # First each variant with a few pivots.
    inside = members.where("k > 1 AND gid <> vid").select(F.col("gid").alias("a"), F.col("vid").alias("b"))
    bit = lambda k: F.bit_or(F.when(F.col("shingle").bitwiseAND(F.lit(64)) == 64 * k, F.expr("shiftleft(1L, cast(shingle & 63 AS INT))")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}")
    have = postings.groupBy("gid").agg(F.count(F.lit(1)).alias("shared"), bit(0), bit(1), F.collect_list("shingle").alias("shingles"))  # a prefix at most
    have = written(have, "posting-lists")
    central = members.join(have, "gid").select("vid", "shared")
    links = verified(pivot_pairs(variants, central, t).unionByName(inside), docs, width, t)
    known = written(components(links), "known")

    # Then all pairs of posting lists that are in different components.
    comp = members.join(known, F.col("vid") == F.col("node"), "left").select("gid", "vid", "k", "last", F.coalesce("component", "vid").alias("comp"))
    comp = written(comp, "comp")
    of = comp.groupBy("gid").agg(F.when(F.min("comp") == F.max("comp"), F.min("comp")).otherwise(NULL_ID).alias("comp"), F.min("last").alias("last"))
    placed = postings.withColumn("place", F.row_number().over(Window.partitionBy("gid").orderBy("shingle")) - 1)
    placed = placed.join(of.join(have.drop("shingles"), "gid"), "gid")
    rest = written(remaining_pairs(placed.select("shingle", "n", "gid", "comp", "last", "shared", "place", "b0", "b1"), t).distinct(), "group-pairs")
    lists = lambda g, s: have.select(F.col("gid").alias(g), F.col("shingles").alias(s))
    rest = rest.join(lists("ga", "sa"), "ga").join(lists("gb", "sb"), "gb").where(F.size(F.array_intersect("sa", "sb")) >= F.col("need")).select("ga", "gb")
    left = comp.select(F.col("gid").alias("ga"), F.col("vid").alias("a"), F.col("comp").alias("ca"))
    right = comp.select(F.col("gid").alias("gb"), F.col("vid").alias("b"), F.col("comp").alias("cb"))
    across = rest.join(left, "ga").join(right, "gb").where("ca <> cb").select("a", "b")
    # Inside groups whose variants are in several components.
    split = comp.where("k > 1").groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gid")
    split = written(comp.join(split, "gid", "left_semi").select("gid", "vid", "comp"), "split-groups")
    if not split.isEmpty():
        inside = remaining_pairs(inner_postings(docs, split, common, width, t), t)
        across = across.unionByName(inside.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    more = verified(across, docs, width, t)
    final = components(links.unionByName(more))

    label = variants.join(final, F.col("vid") == F.col("node"), "left").select("sig", "n", F.coalesce("component", "vid").alias("label"))
    out = sets.select("id", "n", "sig").join(label, ["sig", "n"], "left")
    real = lambda c: F.when(c != NULL_ID, c)
    return out.select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("label", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", width=5, threshold=80) -> DataFrame:
    """docs without those that a smaller id's document is linked to; columns as in docs.

    Rows that go are picked by id: in a broadcast while they take few bytes, else by shuffle.
    """
    out = link_documents(docs.select(id_col, text_col), id_col, text_col, width, threshold)
    gone = small(written(out.where("NOT (doc_id <=> component_id)").select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op6(spark, sf_dir):
    return link_documents(table(spark, sf_dir, "documents"))
