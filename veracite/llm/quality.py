"""Quality scores from a Bradley-Terry model.

A document is a vector of style measurements (rates of byte-class bigrams and a
few redundancy figures). The model has one weight per measurement; the chance
that document a is preferred to b is sigmoid(w . (x_a - x_b)). Weights are fitted
by logistic loss on feature differences of preference pairs (a label-1 document
against a label-0 document). Every labelled row outside the held-out fold takes
part: rows are dealt by a hash into buckets of about ``BUCKET_ROWS``, each bucket
fits weights on pairs of all its rows, and the weights are averaged by rows. A rare
label stands in several buckets. The decision threshold is the strength that
separates the labels of all these rows best, of ``BINS`` even steps. The score
column is shifted so that it lies at 0.7.

Cases: null or empty texts have all-zero bigram rates and get a score like any
other text; repeated rows get equal scores; an empty table gives an empty
result; without labels of both kinds every score is 0.5. Extra columns of the
input are ignored. Every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import bounded_batches, checkpointed, labelled_ids, map_texts, sliced

BUCKET_ROWS = 6000  # labelled rows fitted at once
LEAST = 100  # rows of the rarer label in a bucket, some of them in others too
BINS = 4096
PAIRS_PER_EPOCH = 6000  # at least; each row of a bucket is in a pair
EPOCHS = 30
CLASSES = 16


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[ord(" ")] = 4
    table[ord("\n")] = 5
    table[ord(".")] = 6
    table[ord(",")] = 7
    for c in b"!?":
        table[c] = 8
    table[ord("|")] = 9
    for c in b"#$%&*@^~":
        table[c] = 10
    for c in b"\"'()-:;/":
        table[c] = 11
    for c in b"<>[]{}\\=+_`":
        table[c] = 12
    table[0x80:0xC0] = 13
    table[0xC0:0x100] = 14
    for c in b"\t\r\x0b\x0c":
        table[c] = 15
    return table


BYTE_CLASS = _byte_classes()


def features(text: str) -> np.ndarray:
    """Log-scaled rates of byte-class bigrams of the whole text, then redundancy figures."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(CLASSES * CLASSES)
    for start in range(0, max(len(raw) - 1, 0), 1 << 22):  # bounded memory for very long texts
        part = BYTE_CLASS[raw[start : start + (1 << 22) + 1]].astype(np.intp)
        counts += np.bincount(part[:-1] * CLASSES + part[1:], minlength=CLASSES * CLASSES)
    rates = np.log1p(counts * (1000.0 / max(len(raw), 1)))
    words = text.split()
    lines = text.split("\n")
    n = max(len(words), 1)
    extra = [
        len(set(words)) / n,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(len(raw) / n),
        np.log1p(len(words)),
        np.log1p(n / max(len(lines), 1)),
    ]
    return np.concatenate([rates, extra])


@dataclass(frozen=True)
class BradleyTerry:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale * self.weights).sum(axis=-1)  # row by row, whatever rows come together

    def score(self, x: np.ndarray) -> np.ndarray:
        """0.7 exactly at the threshold quantile, rising with the strength."""
        z = self.strength(x) - self.threshold + np.log(0.7 / 0.3)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7, l2: float = 1e-3) -> BradleyTerry | None:
    """Fit by Adam on the logistic loss of feature differences; None without both labels."""
    if len(x) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-3
    model = BradleyTerry(fit_weights(x, y, mean, scale, seed, l2), mean, scale, 0.0)
    s = model.strength(x)
    bins = histogram_bins(s, s.min(), s.max())
    counts = np.zeros((2, BINS))
    np.add.at(counts, (y.astype(np.intp), bins), 1)
    return BradleyTerry(model.weights, mean, scale, best_cut(counts, s.min(), s.max()))


def histogram_bins(s: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.minimum((s - low) * (BINS / max(high - low, 1e-9)), BINS - 1).astype(np.intp)


def best_cut(counts: np.ndarray, low: float, high: float) -> float:
    """The lower end of the bin that parts label 1 (row 1) from label 0 best, the middle of equally good ones."""
    below = np.cumsum(counts, axis=1) - counts
    gain = 1 - below[1] / counts[1].sum() + below[0] / counts[0].sum()
    best = np.flatnonzero(np.isclose(gain, gain.max()))
    return float(low + best[len(best) // 2] * (high - low) / BINS)


def fit_weights(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int = 7, l2: float = 1e-3) -> np.ndarray:
    """Weights by Adam; in each epoch every row is in a pair, rows of the smaller class in several."""
    z = np.clip((x - mean) / scale, -8, 8)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = max(PAIRS_PER_EPOCH, len(better), len(worse))
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1])
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(EPOCHS):
        a, b = (np.resize(rng.permutation(side), pairs) for side in (better, worse))
        a = rng.permutation(a)  # or the same pairs would come again and again
        for lo in range(0, pairs, 500):
            d = z[a[lo : lo + 500]] - z[b[lo : lo + 500]]
            grad = -(d * (1.0 / (1.0 + np.exp(np.clip(d @ w, -50, 50))))[:, None]).mean(0) + l2 * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def measured_rows(documents: DataFrame, labels: DataFrame, label_col: str, held_out) -> DataFrame:
    """(key, x) of every labelled row outside the held-out fold; the label rides in the key's last bit.

    Texts are measured where they are read, and only the measurements, of one size for any text, are shuffled to
    the labels. These grow with the documents, so the plan does not wait for them to outgrow a broadcast.
    """
    bounded_batches(documents.sparkSession)
    text = F.col("text").cast("string")
    texts = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", text).alias("_hash"), text.alias("_text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = [features(t or "").astype(np.float32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["_id", "_hash", "x"])

    measured = texts.mapInArrow(measure, StructType([*texts.schema.fields[:2], StructField("x", BinaryType())]))
    joined = measured.join(labelled_ids(labels, label_col, held_out).hint("merge"), "_id")
    return joined.select((F.shiftleft("_hash", 1) + F.col("_label")).alias("key"), "x")


def fit(documents: DataFrame, labels: DataFrame, held_out, label_col: str = "quality", bucket_rows: int = BUCKET_ROWS) -> BradleyTerry | None:
    """Fit on every labelled row outside the held-out fold; ``held_out`` is a column expression on ``labels``."""
    measured = checkpointed(measured_rows(documents, labels, label_col, held_out))
    label = F.col("key").bitwiseAND(F.lit(1)).cast("int")
    counts = {r["label"]: r["n"] for r in measured.groupBy(label.alias("label")).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    mean, scale = _moments(measured, sum(counts.values()))

    buckets = -(-sum(counts.values()) // bucket_rows)
    rare = min(counts, key=lambda k: (counts[k], k))
    copies = min(buckets, -(-LEAST * buckets // counts[rare])) if counts[rare] < LEAST * buckets else 1
    places = F.transform(F.sequence(F.lit(0), F.when(label == rare, copies - 1).otherwise(0)), lambda i: F.pmod(F.xxhash64(F.col("key")) + i, F.lit(buckets)).cast("int"))
    dealt = measured.select(F.explode(places).alias("bucket"), "key", "x")

    def fit_bucket(got):
        x, y = _matrix(got["x"]), got["key"].to_numpy() & 1
        order = np.lexsort((*x.T[:8], got["key"]))  # the fit does not depend on the order of arrival
        both = y.min() != y.max()
        w = fit_weights(x[order], y[order], mean, scale) if both else np.zeros(x.shape[1])
        return pd.DataFrame({"bucket": got["bucket"][:1], "n": [len(x) if both else 0], "w": [w.tolist()]})

    fitted = sorted(dealt.groupBy("bucket").applyInPandas(fit_bucket, "bucket int, n long, w array<double>").collect())
    weights = np.average([r["w"] for r in fitted], axis=0, weights=[r["n"] for r in fitted])
    model = BradleyTerry(weights, mean, scale, 0.0)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            s = model.strength(_matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array((keys & 1).astype(np.int32)), pa.array(s)], names=["label", "s"])

    found = measured.mapInArrow(strengths, "label int, s double")
    low, high = found.agg(F.min("s"), F.max("s")).first()
    place = F.least(((F.col("s") - low) * (BINS / max(high - low, 1e-9))).cast("int"), F.lit(BINS - 1))
    table = np.zeros((2, BINS))
    for r in found.groupBy("label", place.alias("bin")).agg(F.count("*").alias("n")).collect():  # two rows a bin at most
        table[r["label"], r["bin"]] = r["n"]
    return BradleyTerry(weights, mean, scale, best_cut(table, low, high))


def _matrix(rows) -> np.ndarray:
    return np.array([np.frombuffer(r, np.float32) for r in rows], np.float64).reshape(len(rows), -1)


def _moments(measured: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of every measurement over all rows; a task adds up its own."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1).to_pylist())
                sums = np.stack([x.sum(0), (x * x).sum(0)])
                total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0].tolist()]), pa.array([total[1].tolist()])], names=["a", "b"])

    parts = measured.mapInArrow(add, "a array<double>, b array<double>")
    one = parts.select(F.posexplode(F.arrays_zip("a", "b")).alias("k", "v")).groupBy("k").agg(F.sum("v.a").alias("a"), F.sum("v.b").alias("b"))
    got = sorted(one.collect())  # a row for each measurement
    a, b = (np.round(np.array([r[c] for r in got]) / n, 9) for c in ("a", "b"))
    return a, np.sqrt(np.maximum(b - a * a, 0)) + 1e-3


def score(documents: DataFrame, model: BradleyTerry | None, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """One row (id, score, predicted) per input row, over whole texts."""
    model_b = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[tuple[list, list]]) -> Iterator[dict]:
        fitted = model_b.value
        for ids, texts in batches:
            if fitted is None or not texts:
                s = np.full(len(texts), 0.5)
            else:
                s = fitted.score(np.array([features(t) for t in texts]))
            yield {id_col: ids, "score": s.tolist(), "predicted": (s >= 0.7).astype(int).tolist()}

    return map_texts(documents, id_col, text_col, run, f"{id_col} {id_type}, score double, predicted int")
