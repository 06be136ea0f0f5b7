"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk toward its diagonal and the pooled covariance; the score is the logistic of
the difference of the two Gaussian log-densities (Mahalanobis terms by cached Cholesky factors) plus the log prior odds,
damped by TEMPER, for statistics that depend on each other, and by words / (words + SHORT), since statistics of few words
say little. A text is scored from its characters alone.

Fitting uses at most MAX_TRAIN labelled ids and as many rows, those with the least hash of doc_id and then of the text; the
rest of the work covers every row.
Null text counts as empty; labels without a quality or doc_id are no examples, of a doc_id with several labels the largest
counts. Without examples of both classes every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MAX_TRAIN = 20_000
THRESHOLD = 0.3
DIAGONAL, POOLED = 0.1, 0.2  # shrinkage weights
TEMPER, SHORT = 0.5, 40
_KIND = np.zeros(256, np.int64)  # byte classes: other ASCII 0, letter 1, capital 2, digit 3, white space 4, line end 5, sentence mark 6, symbol 7, beyond ASCII 8
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:!?'\"()-", 6), (b"#$%&*+/<=>@[\\]^_`{|}~", 7)):
    _KIND[list(_chars)] = _k
_KIND[128:] = 8
FEATURES = 20


def features(text: str | None) -> np.ndarray:
    """Transformed statistics of a text: logs of sizes, logits of shares."""
    raw = (text or "").encode()
    n = len(raw)
    share = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9) / max(n, 1)
    words = raw.lower().split()
    m = len(words)
    lengths = np.fromiter(map(len, words), np.float64, m) if m else np.zeros(1)
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    c = np.fromiter(counts.values(), np.float64, len(counts)) if counts else np.ones(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:]))) / max(m - 1, 1) if m > 1 else 1.0
    sentences = raw.count(b". ") + raw.count(b".\n") + raw.count(b"!") + raw.count(b"?") + 1

    def logit(p: float) -> float:
        return float(np.log((p + 1e-3) / (1 - p + 1e-3)))

    return np.array([
        np.log1p(n), np.log1p(m), *(logit(share[k]) for k in (2, 3, 4, 5, 6, 7, 8)),
        float(lengths.mean()), float(lengths.std()), np.log1p(lengths.max()),
        logit(len(counts) / max(m, 1)), logit(c.max() / max(m, 1)), -float((c / c.sum() * np.log(c / c.sum())).sum()),
        logit(len(set(lines)) / max(len(lines), 1)), logit(pairs), np.log1p(m / sentences), logit(float((lengths <= 3).mean())), np.log1p(len(lines)),
    ])


@dataclass
class Model:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        d = [self.constants[k] - 0.5 * np.square((z - self.means[k]) @ self.factors[k].T).sum(1) for k in (0, 1)]
        words = np.expm1(x[:, 1])
        odds = self.prior + (d[1] - d[0]) * TEMPER * words / (words + SHORT)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model | None:
    """None without two examples of each class."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    parts = [z[y == k] for k in (0, 1)]
    means = np.stack([p.mean(0) for p in parts])
    own = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own)) / len(z)
    factors, constants = [], []
    for p, c in zip(parts, own):
        w = POOLED + (1 - POOLED) * z.shape[1] / (z.shape[1] + len(p))
        c = (1 - w) * c + w * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(factor))
        constants.append(-np.log(np.diag(factor)).sum())
    return Model(centre, scale, means, np.stack(factors), np.array(constants), float(np.log(len(parts[1]) / len(parts[0]))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _matrix(texts: list) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.empty((0, FEATURES))


def _example_rows(batches):
    for batch in batches:
        x = _matrix(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(x), pa.list_(pa.float64()))], ["at", "th", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Model | None:
    """Fits on labelled rows outside the held-out fifth; the ids that are broadcast and the rows that are gathered are max_rows at
    most."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).filter(~held_out(F.col("doc_id")))
    sample = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    examples = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select(F.xxhash64("_id").alias("at"), F.xxhash64("text").alias("th"), "quality", "text")
    measured = examples.mapInArrow(_example_rows, "at long, th long, quality int, x array<double>")
    got = measured.orderBy("at", "th").limit(max_rows).select("quality", "x").toPandas()  # rows that share an id are more than ids
    if not len(got):
        return None
    x, y = np.stack(got["x"]), got["quality"].to_numpy()
    by = np.lexsort((*x.T, y))  # the order of rows doesn't touch the sums
    return fit(x[by], y[by])


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            s = shared.value.score(_matrix(texts)) if shared.value is not None and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], [*batch.schema.names[:-1], "score"])

    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return scored.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if shared.value is not None and batch.num_rows:
                batch = batch.filter(pa.array(shared.value.score(_matrix(batch.column(at).to_pylist())) >= threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)
