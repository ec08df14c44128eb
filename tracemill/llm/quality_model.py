"""Quality by Bradley-Terry ranking.

Each pair of a good and a bad labelled document is a preference. A linear score on text features is
learnt by logistic loss on the pairs' feature differences, and a quantile of the learning documents'
scores is the threshold: the one that parts good from bad with the fewest errors.

Learning uses a sample of at most MOST_LABELLED labelled documents and MOST_PAIRS of their pairs, the
same ones each time. Features are counted over whole texts, and scoring is per document.

Defined results: null and wordless texts have all features 0 but those of length; label rows that repeat
count once, good only if all are; of several texts of one labelled id the first in order is learnt from; without labels of both kinds every score is the threshold; an empty
table gives an empty result; extra columns stay in keep_good() and are ignored in score().
"""

from __future__ import annotations

from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh_names, map_arrow, table
from .logistic import fit_logistic

MOST_LABELLED, MOST_PAIRS = 20_000, 200_000
THRESHOLD = 0.7

_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>~^=_{}[]\\@/+"


def features(text: str | None) -> list[float]:
    """Rates by word or byte, and their logarithms where they have long tails."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    of = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(of(_LETTERS), 1)
    return [
        of(_UPPER) / letters,
        log1p(20 * of(b"!?") / n),
        log1p(20 * of(_SYMBOLS) / n),
        log1p(20 * data.count(b"|") / n),
        of(_DIGITS) / size,
        log(len(set(words)) + 1) / log(n + 1),
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        min(letters / n, 40) / 10,
        log1p(max(map(len, words), default=0)),
        log1p(20 * data.count(b".") / n),
        log1p(20 * data.count(b",") / n),
        log1p(len(words)),
        log1p(20 * len(lines) / n),
        1 - letters / size,
    ]


N_FEATURES = len(features(None))


class Ranking:
    """Scores and their threshold; the features are scaled and clipped, and their squares join them."""

    def __init__(self, x: np.ndarray, good: np.ndarray, most_pairs: int = MOST_PAIRS):
        self.weights, self.threshold = None, 0.0
        if not len(good) or good.all() or not good.any():
            return
        self.middle, self.spread = np.median(x, axis=0), x.std(axis=0) + 1e-6
        z, rng = self._scaled(x), np.random.default_rng(9)
        a, b = np.flatnonzero(good), np.flatnonzero(~good)
        pairs = min(most_pairs, 20 * len(good))
        d = z[rng.choice(a, pairs)]
        d -= z[rng.choice(b, pairs)]
        flip = rng.random(pairs) < 0.5
        d *= np.where(flip, -1.0, 1.0)[:, None]
        self.weights = fit_logistic(d, (~flip).astype(float), 1e-3)
        s = z @ self.weights
        cuts = np.quantile(s, np.linspace(0, 1, 1001))
        errors = np.array([((s >= c) != good).sum() for c in cuts])
        best = np.flatnonzero(errors == errors.min())
        self.threshold = float(cuts[best].mean())

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -4, 4)
        return np.concatenate([z, z * z], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """THRESHOLD and more exactly where the score reaches the threshold."""
        if self.weights is None or not len(x):
            return np.full(len(x), THRESHOLD)
        s = self._scaled(x) @ self.weights - self.threshold
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)) * (1 - THRESHOLD) / THRESHOLD)
        return np.where(s >= 0, np.maximum(p, THRESHOLD), np.minimum(p, np.nextafter(THRESHOLD, 0)))


def _with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    names = [*keep, *(f"f{i}" for i in range(N_FEATURES))]

    def run(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column(len(keep)).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.float64()) for i in range(N_FEATURES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=names)

    schema = StructType([*docs.select(*keep).schema.fields, *(StructField(f"f{i}", DoubleType()) for i in range(N_FEATURES))])
    return map_arrow(docs.select(*keep, "text"), run, schema)


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_pairs: int = MOST_PAIRS) -> Ranking:
    """docs: id, text; labels: id, quality, of any number.

    The fit is on the labelled ids that come first by hash, most_labelled of them, and on most_pairs of their pairs.
    """
    labels = labels.where("id IS NOT NULL AND quality IN (0, 1)").groupBy("id").agg(F.min("quality").cast("int").alias("quality"))
    sample = labels.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    got = _with_features(docs.join(F.broadcast(sample), "id").groupBy("id", "quality").agg(F.min("text").alias("text")), ["id", "quality"]).orderBy("id").toArrow()
    x = np.stack([got.column(f"f{i}").to_numpy() for i in range(N_FEATURES)], axis=1) if got.num_rows else np.zeros((0, N_FEATURES))
    return Ranking(x, got.column("quality").to_numpy() == 1, most_pairs)


def score(docs: DataFrame, ranking: Ranking, id_col="id", text_col="text", out_col="score") -> DataFrame:
    """docs with out_col, _out_col where docs has such a column."""
    (out_col,) = fresh_names(docs, out_col)
    sent = docs.sparkSession.sparkContext.broadcast(ranking)
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                x = np.array([features(t) for t in batch.column(at).to_pylist()]).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.probabilities(x))], names=[*batch.schema.names, out_col])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(out_col, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents at or above the threshold; columns as in docs."""
    (name,) = fresh_names(docs, "score")
    ranking = learn(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labels)
    out = score(docs, ranking, id_col, text_col, name)
    return out.where(F.col(f"`{name}`") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(spark, sf_dir):
    part = lambda c: F.crc32(c.cast("string").cast("binary")) % 4
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality").where(part(F.col("doc_id")) != 2)
    out = score(docs, learn(docs, labels)).select("id", "score")
    held = F.coalesce(part(F.col("id")) == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
