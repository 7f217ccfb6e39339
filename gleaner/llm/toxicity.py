"""Toxicity scores from logistic regression fitted by FTRL-proximal.

Features are hashed word n-grams (one and two words) and skip-grams (two words with one
or two between them) of the lower-cased whole text, each counted once per document. The
fit takes one documented sample of labelled training rows (``SAMPLE`` at most, those of
smallest hash, whole texts) in a fixed order; every coordinate has its own learning
rate, and L1 leaves few non-zero weights, which are broadcast (at most ``2**BITS``).
Every row is scored.

Null and empty texts have no feature and get the score of the bias. Without labelled
rows every score is 0.5. Repeated rows and null ids keep their rows; labels that are
null or contradict each other (the largest counts) do no harm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import slices, text_bytes

BITS = 20
#: Bound of the fitting sample: labelled training rows.
SAMPLE = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 1.0
STRIP = b".,;:!?\"'()[]{}<>*#%&$@|-_+=/\\~`^"


def features(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features of a whole text, sorted."""
    words = [w.strip(STRIP) for w in (text or b"").lower().split()]
    words = [w for w in words if w]
    if not words:
        return np.empty(0, np.int64)
    hash_of = xxhash.xxh3_64_intdigest
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    own = np.fromiter(map(hash_of, index), dtype=np.uint64, count=len(index))
    seq = own[np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))]
    parts = [own]
    for gap in (1, 2, 3):
        if len(seq) > gap:
            pair = seq[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) ^ seq[gap:]
            parts.append(pair * np.uint64(0xD6E8FEB86659FD93))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Follow the regularised leader, proximal form, with per-coordinate rates."""

    def __init__(self, bits: int = BITS):
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = weight * (p - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(sample: DataFrame, text: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the non-zero weights; index ``2**BITS`` is the bias. The
    sample is bounded, and its features are made in parallel."""

    def extract(batches):
        for batch in slices(batches, text):
            rows = [features(t).astype(np.int32).tobytes() for t in text_bytes(batch[text])]
            yield pa.RecordBatch.from_arrays([batch["h"], batch[label], pa.array(rows, pa.binary())],
                                             names=["h", "y", "x"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "y", "x"], kind="stable")
        model, bias = Ftrl(), np.array([1 << BITS])
        share = frame["y"].mean()
        cost = {1: 0.5 / max(share, 0.05), 0: 0.5 / max(1 - share, 0.05)}
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(frame)):
                at = np.concatenate([np.frombuffer(frame["x"].iat[i], dtype=np.int32).astype(np.int64), bias])
                y = int(frame["y"].iat[i])
                model.learn(at, y, cost[y])
        at = np.flatnonzero(np.abs(model.z) > L1)
        return pd.DataFrame({"at": [at.tobytes()], "w": [model.weights(at).tobytes()]})

    made = sample.select("h", F.col(label).cast("int").alias(label), text).mapInArrow(extract, "h long, y int, x binary")
    fitted = made.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(learn, "at binary, w binary").collect()
    if not fitted:
        return np.empty(0, np.int64), np.empty(0)
    return np.frombuffer(fitted[0]["at"], dtype=np.int64), np.frombuffer(fitted[0]["w"])


def predict(df: DataFrame, weights: tuple[np.ndarray, np.ndarray], text: str, out: str = "score") -> DataFrame:
    """Add the score to every row."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        at, w = shared.value
        dense = np.zeros((1 << BITS) + 1, dtype=np.float32)
        dense[at] = w
        for batch in slices(batches, text):
            margins = np.array([dense[features(t)].sum(dtype=np.float64) for t in text_bytes(batch[text])])
            scores = 1 / (1 + np.exp(-np.clip(margins + dense[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=names)

    names = [*df.columns, out]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          folds: int = 5, held: int = 0) -> DataFrame:
    """All input columns plus held_out, score and predicted. Labels are learned only for
    rows whose crc32(key as text) mod ``folds`` is not ``held``."""
    made = ("held_out", "score", "predicted")
    df = df.drop(*[c for c in df.columns if c.lower() in made])
    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(False))
    known = (labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias(label))
             .filter(~F.coalesce(F.crc32(F.col("k").cast("string")) % folds == held, F.lit(True))))
    # the SAMPLE smallest hashes are a bounded top-k; then only their texts are read
    hashed = known.withColumn("h", F.xxhash64(F.col("k").cast("string"))).orderBy("h", "k").limit(SAMPLE)
    sample = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(hashed), "k")
    # an id counts once, however many rows carry it (the least of their texts)
    sample = sample.groupBy("k", "h", label).agg(F.min("t").alias("t"))
    weights = fit(sample.select("h", "t", label), "t", label)
    scored = predict(df.withColumn("held_out", held_out), weights, text)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
