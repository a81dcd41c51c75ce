"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear (logistic) model over the byte n-grams of the
text and the probabilities of the categories before it. So that a later model learns from probabilities as
they will be on unseen texts, the earlier ones it is trained with are out-of-fold predictions.

Training is bounded: ``max_labelled`` documents with labels (the first in the order of a hash of their id),
``n_features`` n-gram buckets chosen by how unevenly the categories hold them. The model that results is a few
arrays. Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, named, unpacked, whole
from quillspark.llm.words import SEGMENT
from quillspark.session import materialize

GRAMS = (5, 7)
BUCKET_BITS = 20
OFTEN = 3


@dataclass(frozen=True)
class Category:
    """A name, and the condition on a row of labels that makes it one of this category."""

    name: str
    holds: str


# Order of the chain: what junk looks like helps to tell what is toxic.
CATEGORIES = (Category("low_quality", "quality = 0"), Category("toxic", "toxic = 1"))


@dataclass
class Chain:
    """``slot`` maps a bucket to its feature or -1; per category: bias, weights, weights of earlier ones, threshold."""

    names: list[str]
    n_features: int
    slot: np.ndarray
    bias: list[float]
    weights: list[np.ndarray]
    earlier: list[np.ndarray]
    threshold: list[float]

    def predict(self, present: np.ndarray) -> list[float]:
        """Probabilities of a text with these features, in the order of the chain."""
        out: list[float] = []
        for bias, weights, earlier in zip(self.bias, self.weights, self.earlier, strict=True):
            out.append(float(_sigmoid(bias + weights[present].sum() + float(np.dot(earlier, out)))))
        return out


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


class Grams:
    """Features of texts: n-grams of bytes, A-Z lower-cased, of the lengths ``GRAMS``; short texts taken together."""

    def __init__(self):
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def _buckets(self, data: np.ndarray, size: int) -> np.ndarray:
        low = self.lower[data].astype(np.uint64)
        n = max(len(low) - size + 1, 0)
        value = low[:n].copy()
        for k in range(1, size):
            value = (value << np.uint64(8)) | low[k : k + n]
        return (value * np.uint64(0x9E3779B97F4A7C15 + 2 * size)) >> np.uint64(64 - BUCKET_BITS)

    def each(self, texts: Sequence[str], slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text in turn its distinct features ``slot[bucket] >= 0``, and how often they stand in it."""
        group: list[bytes] = []
        held = 0
        for text in texts:
            data = text.encode()
            if group and held + len(data) > SEGMENT:
                yield from self._group(group, slot)
                group, held = [], 0
            group.append(data)
            held += len(data)
        if group:
            yield from self._group(group, slot)

    def _group(self, group: list[bytes], slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        together = np.frombuffer(b"".join(group), dtype=np.uint8)
        if len(group) == 1:  # of any length: in pieces
            parts = []
            for size in GRAMS:
                for at in range(0, max(len(together) - size + 1, 0), SEGMENT):
                    found = slot[self._buckets(together[at : at + SEGMENT + size - 1], size)]
                    parts.append(np.unique(found[found >= 0], return_counts=True))
            kept = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
            counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
            features, at = np.unique(kept, return_inverse=True)
            yield features, np.bincount(at, weights=counts, minlength=len(features)).astype(np.int64)
            return
        found, at = [slot[self._buckets(together, size)] for size in GRAMS], 0
        for data in group:
            own = np.concatenate([f[at : at + max(len(data) - size + 1, 0)] for f, size in zip(found, GRAMS, strict=True)])
            yield np.unique(own[own >= 0], return_counts=True)
            at += len(data)


def present_features(features: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Columns of a text: each feature that it holds, and again beyond ``n`` those it holds ``OFTEN`` times."""
    return np.concatenate([features, features[counts >= OFTEN] + n])


def labelled_sample(
    docs: DataFrame, labels: DataFrame, categories: Sequence[Category], max_labelled: int, doc_id: str, text: str
) -> DataFrame:
    """``doc_id, text, y`` (one flag a category) of at most ``max_labelled`` labelled documents.

    Of repeated labels of one document any that holds counts; labels that are all null are left out. Of the rows of a
    repeated id the one with the smallest text is taken, so the bound holds for rows.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.max(F.expr(c.holds).cast("int")).alias(c.name) for c in categories]
    ).dropna(subset=[c.name for c in categories])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    flags = F.array(*[F.col(f"s.{c.name}") for c in categories]).alias("y")
    d = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).alias("d")
    # at most max_labelled rows of a few numbers
    found = d.join(F.broadcast(chosen).alias("s"), F.col("d.doc_id") == F.col("s.doc_id")).select("d.doc_id", "d.text", flags)
    return materialize(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"))


def chosen_buckets(sample: DataFrame, n_categories: int, n_features: int) -> np.ndarray:
    """The buckets that the categories hold most unevenly (a chi-square score), as many for each category."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, identity = Grams(), np.arange(1 << BUCKET_BITS, dtype=np.int32)
        totals = np.zeros((n_categories + 1, 1 << BUCKET_BITS), dtype=np.int32)
        for batch in batches:
            for (present, _), y in zip(grams.each(batch.column(1).to_pylist(), identity), batch.column(2).to_pylist(), strict=True):
                totals[0, present] += 1
                for c in range(n_categories):
                    if y[c]:
                        totals[c + 1, present] += 1
        held = np.flatnonzero(totals[0])
        for at in range(0, len(held), 100_000):
            part = held[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(totals[:, part].T.tolist(), pa.list_(pa.int32()))], ["bucket", "n"]
            )

    sizes = sample.agg(F.count(F.lit(1)), *[F.sum(F.col("y")[c]) for c in range(n_categories)]).first()
    n = sizes[0]
    counts = sample.mapInArrow(count, "bucket int, n array<int>").groupBy("bucket").agg(
        *[F.sum(F.col("n")[c]).alias(f"n{c}") for c in range(n_categories + 1)]
    ).where("n0 >= 3")
    found: list[int] = []
    for c in range(n_categories):
        size = sizes[c + 1] or 0
        if 0 < size < n:
            expected = F.col("n0") * F.lit(size / n)
            score = F.pow(F.col(f"n{c + 1}") - expected, 2) / (expected * (1 - F.col("n0") / (n + 1.0)))
            best = counts.select("bucket", score.alias("score")).orderBy(F.desc("score"), "bucket").limit(n_features // n_categories)
            found += [r["bucket"] for r in best.collect()]
    return np.array(sorted(set(found)), dtype=np.int64)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated gradient descent; a category held by none or all gets a constant."""
    n = len(y)
    positives = float(y.sum())
    start = float(np.log((positives + 0.5) / (n - positives + 0.5)))
    if positives in (0.0, float(n)):
        return start, np.zeros(x.shape[1])
    probe = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(8):  # the largest curvature, by power iteration
        probe = x.T @ (x @ probe)
        probe /= np.linalg.norm(probe) + 1e-12
    curve = 0.25 * (float(np.linalg.norm(x @ probe)) ** 2 + n) + ridge
    w = np.zeros(x.shape[1] + 1, dtype=x.dtype)
    w[0] = start
    v = w.copy()
    for k in range(steps):
        error = _sigmoid(v[0] + x @ v[1:]).astype(x.dtype) - y
        step = np.concatenate([[error.sum()], x.T @ error + ridge * v[1:]]).astype(x.dtype) / curve
        fresh = v - step
        v = fresh + (k / (k + 3)) * (fresh - w)
        w = fresh
    return float(w[0]), w[1:].astype(np.float64)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the highest F1 on out-of-fold predictions, midway to the next lower one; 1.1 without positives."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # not inside a run of equal predictions
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + below) / 2)


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: Sequence[Category] = CATEGORIES, max_labelled: int = 10_000,
    n_features: int = 1024, folds: int = 3, doc_id: str = "doc_id", text: str = "text",
) -> Chain:
    """Train on at most ``max_labelled`` labelled documents and ``n_features`` features, both bounds of the driver's memory.

    A document's fold is a hash of its id. Without labelled documents every probability is one half and
    nothing passes a threshold.
    """
    sample = labelled_sample(docs, labels, categories, max_labelled, doc_id, text)
    bounded_batches(docs.sparkSession)
    buckets = chosen_buckets(sample, len(categories), n_features)
    n = len(buckets)
    slot = np.full(1 << BUCKET_BITS, -1, dtype=np.int16 if n < 1 << 15 else np.int32)
    slot[buckets] = np.arange(n)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            present = [present_features(*f, n).tolist() for f in grams.each(batch.column(1).to_pylist(), slot)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(present, pa.list_(pa.int32())), batch.column(3)], ["doc_id", "y", "present", "fold"])

    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int").alias("fold")
    id_type = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "y", fold).mapInArrow(
        read, f"doc_id {id_type}, y array<int>, present array<int>, fold int"
    ).toArrow()
    names = [c.name for c in categories]
    chain = Chain(names, n, slot, [], [], [], [])
    # the last columns are the out-of-fold probabilities of the categories so far
    x = np.zeros((rows.num_rows, 2 * n + len(names)), dtype=np.float32)
    for i, present in enumerate(rows.column("present")):
        x[i, present.values.to_numpy()] = 1.0
    y = np.array(rows.column("y").to_pylist(), dtype=np.float32).reshape(rows.num_rows, len(names))
    parts = rows.column("fold").to_numpy()
    for c in range(len(names)):
        wide = x[:, : 2 * n + c]
        predicted = np.full(rows.num_rows, 0.5, dtype=np.float32)
        for f in range(folds):
            inside, apart = parts != f, parts == f
            if inside.any() and apart.any():
                bias, weights = fit_logistic(wide[inside], y[inside, c])
                predicted[apart] = _sigmoid(bias + wide[apart] @ weights)
        bias, weights = fit_logistic(wide, y[:, c])
        chain.bias.append(bias if rows.num_rows else 0.0)
        chain.weights.append(weights[: 2 * n])
        chain.earlier.append(weights[2 * n :])
        chain.threshold.append(best_threshold(predicted, y[:, c]))
        x[:, 2 * n + c] = predicted
    return chain


def score_chain(docs: DataFrame, chain: Chain, text: str = "text", category: str = "toxic") -> DataFrame:
    """``docs`` with a column ``p_<category>`` for each category and ``rejected`` for the given one.

    * Null and empty texts have no features and get the probabilities of the bias alone.
    * Every row is scored by its whole text, equal texts alike; an empty table gives no rows.
    * Other columns stay, whatever their names; columns of the names added here are replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [f"p_{name}" for name in chain.names]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for texts in batches:
            rows = np.array([chain.predict(present_features(*f, chain.n_features)) for f in grams.each(texts.to_pylist(), chain.slot)]).reshape(-1, len(names))
            yield pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(len(names))], names)

    own = [c for c in docs.columns if c not in (*names, "rejected")]
    limit = chain.threshold[chain.names.index(category)]
    scored = docs.select(F.struct(*named(own)).alias("row"), predict(whole(text)).alias("p"))
    return scored.select(
        *unpacked("row", own), *unpacked("p", names), (F.col("p").getField(f"p_{category}") >= limit).alias("rejected")
    )

