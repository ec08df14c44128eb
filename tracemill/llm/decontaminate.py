r"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of documents as an executor reads them. Its word sequence is indexed, benchmark
phrases are found by backward search, occurrences are located through sampled suffix positions, and
their spans are merged into what is to be removed.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased. A phrase is ``width``
consecutive words of an item; an item with fewer words, but not none, is one phrase. Words that occur
in no phrase become the shard's separator, so an index has only what a phrase can match; runs shorter
than the shortest phrase, which no phrase fits, are left out of it.

The phrases go to the workers in blocks of at most BLOCK bytes of benchmark text, however large the
benchmark is; each block is one more pass over the documents in the same stage. Nothing is shuffled,
and a task that runs again gives the same rows.

Defined results: null and empty texts have no words and no spans; an empty benchmark hits nothing; a
null item_id is named ``null``; items that repeat are found once; documents that repeat are judged
each; extra columns, also of clashing names, stay with their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh_names, map_arrow, table
from .fm_index import FMIndex

WIDTH = 10
#: Words of a shard.
SHARD = 1_500_000
#: Bytes of benchmark text that are sent to the workers at once.
BLOCK = 8_000_000
#: Rows of an Arrow batch that are searched together, as one shard or more.
SLICE = 4000
#: A-Z become a-z, and what no word holds becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Phrases:
    """Distinct phrases of a block of items, as word ids (1 is the separator), and their items.

    Phrases of one length are the rows of an array; whose they are is a second one: the items of phrase i are
    owners[of[i] : of[i + 1]].
    """

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        rows: dict[int, list[np.ndarray]] = {}
        whose: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)], np.int32)
            if len(ids):
                windows = np.lib.stride_tricks.sliding_window_view(ids, min(width, len(ids)))
                rows.setdefault(windows.shape[1], []).append(windows)
                whose.setdefault(windows.shape[1], []).append(np.full(len(windows), number[item], np.int32))
        self.sigma = len(self.vocabulary) + 1
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(rows):
            patterns, which = np.unique(np.concatenate(rows[n]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(whose[n])], axis=1), axis=0)
            self.by_length[n] = (patterns, np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1].astype(np.int32))
        self.shortest, self.longest = min(self.by_length, default=0), max(self.by_length, default=0)


def _runs(ids: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of each run of at least `least` words that phrases have."""
    known = np.concatenate([[0], (ids > 1).view(np.int8), [0]])
    edge = np.flatnonzero(np.diff(known))
    return [(a, ids[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least]


class _Shard:
    """Runs of several texts, each followed by a separator."""

    def __init__(self):
        self.parts, self.text, self.start, self.size = [], [], [], 0

    def add(self, text: int, start: int, ids: np.ndarray) -> None:
        self.parts += [ids, np.ones(1, np.int64)]
        self.text.append(text)
        self.start.append((self.size, start))
        self.size += len(ids) + 1

    def hits(self, phrases: Phrases, spans: dict[int, list], items: dict[int, set]) -> None:
        """Adds, by text, the (start, end) of every occurrence and the items it comes from."""
        index = FMIndex(np.concatenate(self.parts), phrases.sigma)
        begin, start = np.array([b for b, _ in self.start]), np.array([w for _, w in self.start])
        for n, (patterns, of, owners) in phrases.by_length.items():
            lo, hi = index.search(patterns)
            found = np.flatnonzero(hi > lo)
            count = (hi - lo)[found]
            if not len(found):
                continue
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            rows = np.arange(int(count.sum())) - np.repeat(first - lo[found], count)
            at = index.locate(rows)
            which = np.searchsorted(begin, at, side="right") - 1
            word = at - begin[which] + start[which]
            for run, w, p in zip(which.tolist(), word.tolist(), np.repeat(found, count).tolist(), strict=True):
                t = self.text[run]
                spans.setdefault(t, []).append((w, w + n))
                items.setdefault(t, set()).update(owners[of[p] : of[p + 1]].tolist())


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(texts: list[str | None], phrases: Phrases, shard_words: int = SHARD):
    """For each text: number of words, merged spans, items."""
    same: dict[str, int] = {}
    slot = [same.setdefault(t or "", len(same)) for t in texts]  # copies in a shard are indexed once
    n_words, spans, items, shard = [], {}, {}, _Shard()
    step = max(shard_words, 2 * phrases.longest)
    for k, text in enumerate(same):
        words = words_of(text)
        n_words.append(len(words))
        if not phrases.longest or len(words) < phrases.shortest:
            continue
        ids = np.fromiter(map(phrases.vocabulary.get, words, repeat(1)), np.int64, len(words))
        for start, run in _runs(ids, phrases.shortest):
            for i in range(0, len(run), step):  # parts of very long runs overlap by a phrase less a word
                shard.add(k, start + i, run[i : i + step + phrases.longest - 1])
        if shard.size >= shard_words:
            shard.hits(phrases, spans, items)
            shard = _Shard()
    if shard.size:
        shard.hits(phrases, spans, items)
    return [(n_words[k], merged(spans.get(k, ())), sorted(phrases.items[i] for i in items.get(k, ()))) for k in slot]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Whether it is the last one, and items: parts of about BLOCK bytes, one where all of them are smaller."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield i == n - 1, [(r.item, r.text) for r in part.toLocalIterator()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", width=WIDTH, names=None) -> DataFrame:
    """docs with n_words long, spans array<struct<start, end>> of words, items array<string>.

    Where docs has a column of such a name, ours gets an underscore in front.
    """
    names = names or fresh_names(docs, "n_words", "spans", "items")
    return _searched(docs, benchmark, text_col, item_col, item_text_col, width, names, cut=False)


def _searched(docs, benchmark, text_col, item_col, item_text_col, width, names, cut: bool) -> DataFrame:
    """One pass for each block of the benchmark; the last one returns docs with `names`, or their cut texts."""
    sc = docs.sparkSession.sparkContext
    at, have = docs.columns.index(text_col), len(docs.columns)
    found = StructType([*docs.schema.fields, StructField(names[0], LongType()), StructField(names[1], ArrayType(SPAN)), StructField(names[2], ArrayType(StringType()))])
    out_types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    out = docs
    for last, block in _blocks(benchmark, item_col, item_text_col):
        sent = sc.broadcast(Phrases(block, width))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, cuts=cut and last) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
                texts = batch.column(at).to_pylist()
                got = scan(texts, sent.value)
                if batch.num_columns > have:  # what earlier blocks found
                    before = zip(batch.column(have + 1).to_pylist(), batch.column(have + 2).to_pylist(), strict=True)
                    got = [(n, merged([*s, *((x["start"], x["end"]) for x in s0)]), sorted({*i, *i0})) for (n, s, i), (s0, i0) in zip(got, before, strict=True)]
                cols = list(batch.columns[:have])
                if cuts:
                    cols[at] = pa.array([without_spans(t, s) for t, (_, s, _) in zip(texts, got, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:have])
                    continue
                more = [[n for n, _, _ in got], [[{"start": a, "end": b} for a, b in s] for _, s, _ in got], [i for _, _, i in got]]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, t) for c, t in zip(more, out_types, strict=True))], names=[*batch.schema.names[:have], *names])

        out = map_arrow(out, run, docs.schema if cut and last else found)
    return out


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of the spans and what stands between words of one span."""
    if not spans or text is None:
        return text
    import re

    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.translate(FOLD))]
    kept, end = [], 0
    for a, b in spans:
        kept.append(data[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*kept, data[end:]]).decode("utf-8", "surrogatepass")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", width=WIDTH) -> DataFrame:
    """docs with every benchmark passage cut out of the text; rows and columns stay."""
    return _searched(docs, benchmark, text_col, item_col, item_text_col, width, fresh_names(docs, "n_words", "spans", "items"), cut=True)


def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS g FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT r, i, g.n, item FROM g JOIN p ON g.g = p.g AND g.n = p.n),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
