"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import slices, write_scratch
from nimbora.llm.ngrams import bounded_sample, fold, hashed_ngrams

SIZES = (4, 5)
BITS = 18
#: Bound of the training sample: so many labelled documents of each class.
PER_CLASS = 3000
#: n-grams kept: those whose log-likelihood ratio against independence of the class is at least
#: this (chi-squared, one degree: chance alone puts about two of all buckets above it), and of
#: these at most FEATURES, the largest. Rare insults pass, the noise of long texts doesn't.
SIGNIFICANT = 20.0
FEATURES = 20_000
LEAST_DOCUMENTS = 5
PENALTY = 1e-3


@dataclass
class ToxicityModel:
    """`weights` has one number per bucket: classifier weight times log-count ratio."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS

    def score(self, text: str | None) -> float:
        """Chance of the toxic class. Presence counts, so length does not water it down."""
        seen = np.zeros(1 << self.bits, dtype=bool)
        seen[hashed_ngrams((text or "").lower(), self.sizes, self.bits)] = True
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[seen].sum(), -30, 30))))


def select(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """The chosen buckets and their log-count ratios, from documents of each class per bucket."""
    ratio = np.log((1 + toxic) / (2 + n_toxic)) - np.log((1 + clean) / (2 + n_clean))
    n, total = toxic + clean, max(n_toxic + n_clean, 1)
    strength = np.zeros(len(n))
    for seen, size in ((toxic, n_toxic), (clean, n_clean)):
        for cell, expected in ((seen, n * size / total), (size - seen, (total - n) * size / total)):
            strength += 2 * cell * np.log(np.maximum(cell, 1e-9) / np.maximum(expected, 1e-9))
    strength *= n >= LEAST_DOCUMENTS
    chosen = np.argsort(-strength, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[strength[chosen] >= SIGNIFICANT])
    return chosen, ratio[chosen]


def fit(features: list[np.ndarray], labels: np.ndarray, row_weights: np.ndarray, chosen: np.ndarray, ratio: np.ndarray) -> ToxicityModel:
    """Logistic regression on presence times log-count ratio.

    `features` holds, for each document, places in `chosen`. With one class only, or none, the
    score is the same for every text.
    """
    share = np.clip((row_weights * labels).sum() / max(row_weights.sum(), 1e-9), 0.01, 0.99)
    weights, base = np.zeros(1 << BITS, dtype=np.float32), float(np.log(share / (1 - share)))
    if labels.min(initial=1) == labels.max(initial=0) or not len(chosen):
        return ToxicityModel(weights, base)
    columns = np.concatenate(features)
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    value = ratio[columns]
    w, bias = np.zeros(len(chosen)), base
    slope, slope0 = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(150):
        z = bias + np.bincount(rows, weights=value * w[columns], minlength=len(labels))
        error = row_weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / row_weights.sum()
        grad = np.bincount(columns, weights=value * error[rows], minlength=len(chosen)) + PENALTY * w
        slope += grad**2
        slope0 += error.sum() ** 2
        w -= 0.1 * grad / np.sqrt(slope)
        bias -= 0.1 * error.sum() / np.sqrt(slope0)
    weights[chosen] = w * ratio
    return ToxicityModel(weights, float(bias))


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS,
    key: str = "doc_id", text: str = "text", label: str = "toxic",
) -> ToxicityModel:
    """Fit on at most `per_class` labelled documents of each class outside the held-out fold.

    Null keys, null labels and labels other than 0 and 1 are left out; a document with several
    labels counts as toxic if any says so. Row weights restore the classes' shares. Without
    labelled documents every score is that of a rare class. The sample is what reaches the driver.
    """
    import pyarrow as pa

    usable = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(
        F.col("k").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("k"), folds) != held_out)
    )
    usable = usable.groupBy("k").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    sample = bounded_sample(usable, per_class, "y", "k")

    def features(batches):
        for batch in slices(batches):
            found = [
                np.unique(hashed_ngrams((t or "").lower(), SIZES, BITS)).astype("<u4").tobytes()
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["k", "y", "f"])

    def counts(batches):
        seen = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in slices(batches):
            for y, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen[y, np.frombuffer(f, "<u4")] += 1
        at = np.flatnonzero(seen.any(axis=0))
        for part in np.array_split(at, len(at) // 10_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[1][part]), pa.array(seen[0][part])], ["bucket", "toxic", "clean"])

    def kept(batches):
        place = np.full(1 << BITS, -1)
        place[chosen] = np.arange(len(chosen))
        for batch in slices(batches):
            places = [place[np.frombuffer(f, "<u4")] for f in batch.column(2).to_pylist()]
            found = [p[p >= 0].astype("<u4").tobytes() for p in places]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["k", "y", "f"])

    # At most 2 * per_class rows of two numbers, so the sample may be broadcast.
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null")
    texts = texts.join(F.broadcast(sample), "k").select(F.col("k").cast("string").alias("k"), "t", "y")
    fields = "k string, y int, f binary"
    rows, _ = write_scratch(texts.mapInArrow(features, fields), "toxic-sample")
    sums = rows.mapInArrow(counts, "bucket long, toxic long, clean long").groupBy("bucket")
    sums = sums.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = sums.filter(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS).toArrow()
    seen = np.zeros((2, 1 << BITS))
    for i, name in enumerate(("clean", "toxic")):
        seen[i, sums.column("bucket").to_numpy()] = sums.column(name).to_numpy()
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    chosen, ratio = select(seen[1], seen[0], sizes.get(1, 0), sizes.get(0, 0))
    # The sample with its chosen buckets: some MB at most, by the bounds of sample and choice.
    data = sorted(rows.mapInArrow(kept, fields).collect())
    y = np.array([r["y"] for r in data], dtype=float)
    weight = [totals.get(c, 0) / max(1, sizes.get(c, 0)) for c in (0, 1)]
    places = [np.frombuffer(r["f"], "<u4").astype(np.int64) for r in data]
    return fit(places, y, np.where(y == 1, weight[1], weight[0]), chosen, ratio)


def with_score(docs: DataFrame, model: ToxicityModel, text: str = "text", column: str = "score") -> DataFrame:
    """All columns and rows of `docs`, and the score of each whole text (null: as empty).
    `column` must not be among the columns; the model (1 MB) travels with the tasks; the text is the only input of a score."""
    import pyarrow as pa

    at = docs.columns.index(text)

    def scored(batches):
        for batch in slices(batches):
            scores = [model.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    from pyspark.sql import types as T

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
