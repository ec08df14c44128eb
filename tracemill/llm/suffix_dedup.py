"""Suffix-array dedup: what lies under a long string that also starts elsewhere is removed.

A text is a sequence of symbols: its UTF-8 bytes, or its words. A symbol goes if some ``width``-symbol window
over it equals a window at another place of the corpus. Windows are found in three steps, each of which
only hands on what the next must look at.

1. Every window has a content-defined anchor, so equal windows meet under equal anchor hashes (see
   anchors.py). One row a run of windows is counted by that hash; a hash that occurs once means windows that
   occur once.
2. Runs whose context (all symbols of their windows) is the same elsewhere are repeated as a whole. That is
   counting, and settles copies of any number.
3. Where one hash has several contexts, each distinct context goes once to a logarithmic family of suffix
   arrays (see Family): a batch of contexts gets a suffix array, is searched for in every level's, and
   levels of equal size merge, so a context takes part in a logarithmic number of merges.

A hash with more than HOT contexts, as a common line in different surroundings has, is divided before step 3: by
more of what stands before the anchor for the windows that reach far enough back, by more of what stands after it
for the others. Equal windows stay together, equal parts are counted as in step 2, and every round halves what is
left to add, so groups end below HOT contexts however often something is said.

Counting is partial before its shuffle, so a hot text costs a row a task.

Defined results: a null text is empty; texts under ``width`` symbols keep all; rows that repeat are each
other's repeats; an empty table gives an empty result; matches never cross documents; extra columns stay
with their document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import fresh_names, map_arrow, small, table, written

#: Symbols of a text that are handled at once.
PART = 200_000
#: Contexts of a batch of the family, and of a hash group before it is divided.
BATCH, HOT = 400, 800


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of; size is how many bytes a symbol has in a context."""

    name: str
    width: int
    gram: int
    size: int


BYTES = Unit("bytes", 400, 64, 1)
#: Words are runs of anything but ASCII white space; a word is its 64-bit hash.
WORDS = Unit("words", 50, 8, 8)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Words:
    """Hashes of words, cached up to a bound."""

    def __init__(self, most: int = 150_000):
        self.known, self.most = {}, most

    def __call__(self, text: bytes) -> np.ndarray:
        known, out = self.known, []
        for w in text.split():
            h = known.get(w)
            if h is None:
                if len(known) >= self.most:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def _symbols(unit: Unit):
    return _Words() if unit.size == 8 else lambda text: np.frombuffer(text, np.uint8)


def _packed(symbols: np.ndarray) -> bytes:
    """Symbols as bytes that sort as they do."""
    return symbols.tobytes() if symbols.itemsize == 1 else symbols.astype(">u8").tobytes()


# --- the family of suffix arrays


def truncated_suffix_array(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The places from which width bytes lie inside one string, in order of those bytes, and whether each
    differs from the one before it.

    data: the strings, which start at begin and have the given sizes, one after the other; only every step-th
    place of a string counts. By prefix doubling, as far as a match is long.
    """
    n = len(data)
    room = np.repeat(begin + size, size) - np.arange(n)
    room[np.arange(n) % step != 0] = 0
    k = min(8, width)
    at = np.flatnonzero(room >= k)
    key = np.zeros(len(at), np.uint64)
    for j in range(k):
        key = (key << np.uint64(8)) | data[at + j].astype(np.uint64)
    rank = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.zeros(0, bool)
        if k == width:
            return at, new
        rank[at] = np.cumsum(new)
        more = min(k, width - k)
        at = np.flatnonzero(room >= k + more)
        key = (rank[at] * (n + 1) + rank[at + more]).astype(np.uint64)
        k += more


class Level:
    """Strings, the suffix array of their windows, and which of these are found at another place."""

    def __init__(self, data: np.ndarray, numbers: np.ndarray, begin: np.ndarray, at: np.ndarray, again: np.ndarray, width: int):
        self.data, self.numbers, self.begin, self.at, self.again, self.width = data, numbers, begin, at, again, width
        # Every place's window, without a copy. Strings of bytes compare as unsigned bytes over their whole width.
        self.windows = np.ndarray((max(len(data) - width + 1, 0),), f"S{width}", data, 0, (1,)) if len(data) >= width else np.zeros(0, f"S{width}")

    @classmethod
    def of(cls, numbers: np.ndarray, strings: list[bytes], width: int, step: int) -> Level:
        data = np.frombuffer(b"".join(strings), np.uint8)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        at, new = truncated_suffix_array(data, begin, size, width, step)
        again = ~(new & np.concatenate([new[1:], [True]])) if len(at) else new
        return cls(data, numbers, begin, at, again, width)

    def _places(self, other: Level) -> np.ndarray:
        """Where each of other's windows stands in this suffix array, by binary search, many at a time."""
        out = np.zeros(len(other.at), np.int64)
        for i in range(0, len(other.at), 4096):
            v = other.windows[other.at[i : i + 4096]]
            lo, hi = np.zeros(len(v), np.int64), np.full(len(v), len(self.at))
            for _ in range(len(self.at).bit_length()):
                mid = (lo + hi) // 2
                less = (lo < hi) & (self.windows[self.at[np.minimum(mid, len(self.at) - 1)]] < v)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.maximum(mid, lo))
            out[i : i + 4096] = lo
        return out

    def scan(self, other: Level) -> None:
        """Notes in both which windows of other are here too. Several equal ones here are known already."""
        if not len(self.at) or not len(other.at):
            return
        slot = self._places(other)
        there = np.flatnonzero(slot < len(self.at))
        for part in np.array_split(there, len(there) // 4096 + 1):
            same = part[self.windows[self.at[slot[part]]] == other.windows[other.at[part]]]
            other.again[same] = True
            self.again[slot[same]] = True

    def merged(self, other: Level) -> Level:
        """One level of both: other's suffixes go to their places in this one's order."""
        slot = self._places(other) if len(self.at) else np.zeros(len(other.at), np.int64)
        n = len(self.data)
        return Level(
            np.concatenate([self.data, other.data]),
            np.concatenate([self.numbers, other.numbers]),
            np.concatenate([self.begin, other.begin + n]),
            np.insert(self.at, slot, other.at + n),
            np.insert(self.again, slot, other.again),
            self.width,
        )

    def found(self, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the string, first and end byte of each run of windows that are found again."""
        at = np.sort(self.at[self.again])
        which = np.searchsorted(self.begin, at, side="right") - 1
        new = np.concatenate([[True], (np.diff(at) != step) | (np.diff(which) != 0)]) if len(at) else np.zeros(0, bool)
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
        w = which[first] if len(first) else first
        return self.numbers[w], at[first] - self.begin[w], at[last[: len(first)]] - self.begin[w] + self.width


class Family:
    """Levels of falling size: a batch is searched for in each, and merges with the last while that is no larger.

    Width and step are in bytes.
    """

    def __init__(self, width: int, step: int = 1):
        self.width, self.step, self.levels = width, step, []

    def add(self, numbers: np.ndarray, strings: list[bytes]) -> None:
        new = Level.of(numbers, strings, self.width, self.step)
        for level in self.levels:
            level.scan(new)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2].data) <= len(self.levels[-1].data):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)

    def found(self) -> list[tuple[int, int, int]]:
        return [row for level in self.levels for row in zip(*(x.tolist() for x in level.found(self.step)), strict=True)]


# --- what runs on the executors


def _runs_of(batch: pa.RecordBatch, unit: Unit, symbols):
    ids, marks, texts = (batch.column(i) for i in range(3))
    width, size = unit.width, unit.size
    for doc, mark, text in zip(ids.to_pylist(), marks.to_pylist(), texts.to_pylist(), strict=True):
        if text is None or len(text) < width:
            continue
        data = symbols(text)
        buf = _packed(data)
        for part in range(0, len(data) - width + 1, PART):
            first, count, anchor, h = anchors.runs(data[part : part + PART + width - 1], width, unit.gram)
            off = anchor - first
            first = first + part
            digest = [xxhash.xxh3_128_digest(buf[size * i : size * (i + k + width - 1)], seed=o) for i, k, o in zip(first.tolist(), count.tolist(), off.tolist(), strict=True)]
            two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            # What repeats with a short period has one context over and over: a row for all of these.
            new = np.flatnonzero(np.concatenate([[True], (two[1:] != two[:-1]).any(axis=1) | (count[1:] != count[:-1])]))
            times = np.diff(np.append(new, len(count)))
            yield doc, mark, first[new], count[new], times, off[new], h[new].view(np.int64), two[new, 0], two[new, 1]


def _anchor_table(docs: DataFrame, unit: Unit) -> DataFrame:
    """A row for each run of windows, or for as many as `times` runs of one context that follow each other.

    first and n_windows are in symbols, off is the anchor's place in the first window.
    """
    names = ["id", "mark", "first", "n_windows", "times", "off", "h", "c1", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _symbols(unit)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                rows = list(_runs_of(whole.slice(i, 500), unit, symbols))
                if not rows:
                    continue
                n = [len(r[2]) for r in rows]
                ids = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
                cols = [ids, pa.array(np.repeat(np.array([r[1] for r in rows], np.int64), n))]
                for k, kind in enumerate((np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int64), 2):
                    cols.append(pa.array(np.concatenate([r[k] for r in rows]).astype(kind)))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(docs.select("id", "mark", "data"), run, "id long, mark long, first long, n_windows int, times int, off int, h long, c1 long, c2 long")


_CONTEXT = "h long, n long, id long, mark long, first long, n_windows int, off int, gram int, context binary"


def _contexts(picked: DataFrame, unit: Unit) -> DataFrame:
    """picked: id, mark, data, wanted array<struct<first, n_windows, off, h, n>>; a row for each that is wanted."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]

    def run(batches):
        symbols = _symbols(unit)
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                rows = []
                for doc, mark, text, wanted in zip(*(c.to_pylist() for c in whole.slice(i, 200).columns), strict=True):
                    buf = _packed(symbols(text))
                    for w in wanted:
                        a, b = w["first"] * unit.size, (w["first"] + w["n_windows"] + unit.width - 1) * unit.size
                        rows.append((w["h"], w["n"], doc, mark, w["first"], w["n_windows"], w["off"], unit.gram, buf[a:b]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_arrow(picked, run, _CONTEXT)


def _promising(contexts: list[bytes], unit: Unit) -> np.ndarray:
    """Flags of the contexts with a window whose fingerprint is another's too."""
    data = [np.frombuffer(c, np.uint8 if unit.size == 1 else ">u8") for c in contexts]
    prints = [anchors.gram_hashes(d if unit.size == 1 else d.astype(np.uint64), unit.width) for d in data]
    which = np.repeat(np.arange(len(contexts)), [len(p) for p in prints])
    prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    out = np.zeros(len(contexts), bool)
    out[which[order[1:][same]]] = True
    out[which[order[:-1][same]]] = True
    return out


def _repeated_windows(contexts: DataFrame, unit: Unit) -> DataFrame:
    """Spans of symbols for windows of contexts that occur once as a whole. contexts: sorted by h within partitions."""

    def spans(family: Family, rows: list[tuple]):
        out = []
        for k, start, end in family.found():
            n, doc, mark, first = rows[k]
            if n == 1:  # else settled by counting
                out.append((doc, mark, first + start // unit.size, first + end // unit.size))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["id", "mark", "start", "end"])

    def run(batches):
        family, rows, group = None, [], None  # of the group that the last row was in, which may go on
        for batch in (whole.slice(i, BATCH) for whole in batches for i in range(0, whole.num_rows, BATCH)):
            h, strings = batch.column(0).to_numpy(), batch.column(5).to_pylist()
            cols = list(zip(*(c.to_pylist() for c in batch.columns[1:5]), strict=True))
            edge = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            goes_on = int(family is not None and group == h[0])
            begin, last = edge[1] if goes_on else 0, edge[-2]
            pieces = [(0, edge[1], True)] * goes_on + [(begin, last, False)] * int(begin < last) + [(last, len(h), False)] * int(last >= begin)
            for a, b, same in pieces:
                if not same:
                    if family is not None:
                        yield spans(family, rows)
                    family, rows = Family(unit.width * unit.size, unit.size), []
                part = list(range(a, b))
                if b < len(h) and not same:  # whole groups
                    part = [a + int(k) for k in np.flatnonzero(_promising(strings[a:b], unit))]
                if part:
                    family.add(np.arange(len(rows), len(rows) + len(part)), [strings[k] for k in part])
                    rows += [cols[k] for k in part]
            group = h[-1]
        if family is not None:
            yield spans(family, rows)

    return map_arrow(contexts.select("h", "n", "id", "mark", "first", "context"), run, "id long, mark long, start long, end long")


# --- the plan


def _halves(contexts: DataFrame, unit: Unit) -> DataFrame:
    """Each context's windows with an anchor that stands far in them, and the others, under hashes of longer grams.

    The room is what a window has besides its gram. Windows whose anchor has half of it before it are told
    apart by that half, the others by as much after the anchor as all of them have.
    """
    c, w, size = F.col, F.lit(unit.width), unit.size
    room = w - c("gram")
    half = F.floor((room + 1) / 2).cast("int")
    after = room - half + 1
    n = F.greatest(F.lit(0), F.least(c("n_windows"), c("off") - half + 1))
    cut = lambda first, count: F.substring(c("context"), first * size + 1, count * size)
    part = lambda shift, count, off, gram, at: F.struct(
        F.xxhash64("h", cut(at, gram)).alias("h"), (c("first") + shift).alias("first"), count.alias("n_windows"), off.alias("off"), gram.cast("int").alias("gram"), cut(shift, count + w - 1).alias("context")
    )
    front = part(F.lit(0), n, c("off") - half, c("gram") + half, F.greatest(c("off") - half, F.lit(0)))
    back = part(n, c("n_windows") - n, c("off") - n, c("gram") + after, c("off"))
    out = contexts.select("n", "id", "mark", F.explode(F.array(front, back)).alias("p")).where("p.n_windows > 0")
    return out.select("n", "id", "mark", "p.*").select("*", F.xxhash64("context").alias("c1"), F.xxhash64(F.lit(1), "context").alias("c2"))


def _divided(contexts: DataFrame, unit: Unit) -> tuple[DataFrame, list[DataFrame]]:
    """contexts in groups of HOT at most, and the spans that are settled on the way."""
    settled, done = [], []
    while True:
        hot = written(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("h"), "hot-anchors")
        if hot.isEmpty():
            for more in done:
                contexts = contexts.unionByName(more)
            return contexts, settled
        both = written(_halves(contexts.join(small(hot), "h", "left_semi"), unit), "halves")
        loc = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "first")).alias("loc")
        same = both.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), loc, *[F.min(x).alias(x) for x in ("n_windows", "off", "gram")], F.min("context").alias("context"))
        same = written(same, "halves-counted")
        often = same.where("k > 1").select("h", "c1", "c2")
        ends = (F.col("first") + F.col("n_windows") + (unit.width - 1)).alias("end")
        settled.append(both.where("n = 1").join(small(often), ["h", "c1", "c2"], "left_semi").select("id", "mark", F.col("first").alias("start"), ends))
        several = same.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
        rest = same.join(small(several), "h", "left_semi").select("h", F.when(F.col("k") > 1, F.lit(2).cast("long")).otherwise(F.col("n")).alias("n"), "loc.id", "loc.mark", "loc.first", "n_windows", "off", "gram", "context")
        done.append(contexts.join(small(hot), "h", "left_anti"))
        contexts = written(rest, "contexts-divided")


def _with(docs: DataFrame, per_doc: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with per_doc's column, null for some that per_doc has not, and the docs that are left out of these.

    Few documents are picked by a hash, and the others' texts are not moved; many meet by shuffle, all docs in one.
    """
    right = per_doc.select(F.col("id").alias("rid"), F.col("mark").alias("rmark"), column)
    match = lambda left: left.join(right, left["id"].eqNullSafe(right["rid"]) & (left["mark"] == right["rmark"]), "left").drop("rid", "rmark")
    keys = per_doc.select(F.xxhash64("id", "mark").alias("key")).distinct()
    sent = small(keys)
    if sent is keys:
        return match(docs), None
    keyed = docs.withColumn("key", F.xxhash64("id", "mark"))
    return match(keyed.join(sent, "key", "left_semi").drop("key")), keyed.join(sent, "key", "left_anti").drop("key")


def repeated_spans(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """id, mark, spans array<struct<start, end>> of symbols (unordered, they may overlap) of docs of (id, mark, data)."""
    a = written(_anchor_table(docs, unit), "anchors")
    same = a.groupBy("h").agg(F.sum("times").alias("k"), ((F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))).alias("mixed"))
    same = written(same.where("k > 1").select("h", "mixed"), "repeated-anchors")
    dup = written(a.join(small(same), "h"), "repeated-runs")
    loc = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "first", "n_windows", "off")).alias("loc")
    contexts = written(dup.groupBy("h", "mixed", "c1", "c2").agg(F.sum("times").alias("n"), loc), "contexts")
    often = contexts.where("n > 1").select("c1", "c2")
    whole = dup.join(small(often), ["c1", "c2"], "left_semi")
    whole = whole.select("id", "mark", F.col("first").alias("start"), (F.col("first") + F.col("n_windows") * F.col("times") + (unit.width - 1)).alias("end"))

    wanted = contexts.where("mixed").groupBy(F.col("loc.id").alias("id"), F.col("loc.mark").alias("mark")).agg(
        F.collect_list(F.struct(F.col("loc.first").alias("first"), F.col("loc.n_windows").alias("n_windows"), F.col("loc.off").alias("off"), "h", "n")).alias("wanted")
    )
    texts, _ = _with(docs, written(wanted, "wanted"), "wanted")
    texts = written(_contexts(texts.where("wanted IS NOT NULL").select("id", "mark", "data", "wanted"), unit), "texts")
    texts, settled = _divided(texts, unit)
    parts = _repeated_windows(texts.repartition("h").sortWithinPartitions("h"), unit)
    spans = whole.unionByName(parts)
    for more in settled:
        spans = spans.unionByName(more)
    return written(spans.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)], strict=True))


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that lie in them in part."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def _bytes_of_words(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From the first word of a span to the word after its last one."""
    at = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    return [(at[a], at[b]) for a, b in spans]


def _keyed(docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    ).withColumn("mark", F.xxhash64("data"))


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", unit: Unit = BYTES) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long) and kept (binary) by bytes; the text column itself goes.

    Where docs has a column of such a name, ours gets an underscore in front.
    """
    names = fresh_names(docs, *_OUT)
    others = [c for c in docs.columns if c != text_col]
    whole = _keyed(docs, id_col, text_col, others)
    cut, rest = _with(whole, repeated_spans(whole.select("id", "mark", "data"), unit), "spans")

    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            sizes, gone, count, kept = [], [], [], []
            for data, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = merged(s)
                kept.append(_without(data, spans))
                sizes.append(len(data))
                gone.append(len(data) - len(kept[-1]))
                count.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, count)), pa.array(kept, pa.binary())], names=["row", *_OUT])

    schema = whole.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    out = map_arrow(cut.select("row", "data", "spans"), run, schema)
    if rest is not None:
        zero = F.lit(0).cast("long")
        out = out.unionByName(rest.select("row", F.octet_length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("data").alias("kept")))
    return out.select(*[F.col(f"row.`{c}`") for c in others], *[F.col(a).alias(b) for a, b in zip(_OUT, names, strict=True)])


_OUT = ["n_bytes", "n_removed", "n_spans", "kept"]


def drop_repeats(docs: DataFrame, id_col="doc_id", text_col="text", unit: Unit = WORDS) -> DataFrame:
    """docs with the repeats cut out of the text, every copy of them; rows and columns stay.

    By words a span goes up to the word after it; by bytes a character that lies in a span in part stays.
    A null text stays null.
    """
    others = [c for c in docs.columns if c != text_col]
    whole = _keyed(docs, id_col, text_col, docs.columns)
    cut, rest = _with(whole, repeated_spans(whole.select("id", "mark", "data"), unit), "spans")
    bounds = _bytes_of_words if unit.size == 8 else _whole_characters

    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            kept = [_without(data, bounds(data, merged(s)) if s else []) for data, s in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())], names=["row", "kept"])

    out = map_arrow(cut.select("row", "data", "spans"), run, whole.select("row").schema.add("kept", "string"))
    if rest is not None:
        out = out.unionByName(rest.select("row", F.col("data").cast("string").alias("kept")))
    text = F.when(F.col(f"row.`{text_col}`").isNotNull(), F.col("kept")).alias(text_col)
    return out.select(*[F.col(f"row.`{c}`") for c in others], text).select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_words(docs: DataFrame, id_col="doc_id", text_col="text", unit: Unit = WORDS) -> DataFrame:
    """id, mark, n: how many symbols of the text with hash mark lie under repeats; only documents that have any."""
    spans = repeated_spans(_keyed(docs, id_col, text_col, [id_col]).select("id", "mark", "data"), unit)
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"))
    return spans.select("id", "mark", F.aggregate(F.array_sort("spans"), start, add, lambda a: a["n"]).alias("n"))


def op4(spark, sf_dir):
    """The contract's columns, by bytes, and n_passage_words: words under runs of 50 words that also start elsewhere.

    A passage of 50 words often has less than 400 bytes; the last column tells of these too, and cuts nothing.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = repeated_words(docs)
    keyed = docs.withColumn("text_mark", F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    out = remove_repeats(keyed).select("doc_id", "text_mark", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    out = out.join(small(words), out["doc_id"].cast("long").eqNullSafe(words["id"]) & (out["text_mark"] == words["mark"]), "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n", F.lit(0).cast("long")).alias("n_passage_words"))
