"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased. Their hashes are combined to unigrams, bigrams and
skip-grams that leave one word out; a feature counts once for a text. Per-coordinate learning rates and the
L1 term leave few weights other than zero, so the model that goes to the executors is small whatever the corpus.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.llm import common

BITS = 18
#: Letters and digits stay, other ASCII bytes separate words.
FOLD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
MIX, TWO, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word; all bytes of a word count, those from the 65th on with the powers over again."""
    b = FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    word = b != 32
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not starts.size:
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(word)
    length = ends - starts
    first = np.cumsum(length) - length
    inside = np.arange(at.size) - np.repeat(first, length)
    h = np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * POWERS[inside & 63], first)
    h = (h ^ (h >> np.uint64(29)) ^ length.astype(np.uint64)) * MIX
    return h ^ (h >> np.uint64(32))


def features(text: str) -> np.ndarray:
    """Bucket numbers of the unigrams, bigrams and one-word skip-grams, with repeats."""
    h = word_hashes(text)
    two = (h[:-1] * TWO + h[1:]) * MIX
    skip = (h[:-2] * SKIP + h[2:]) * MIX
    return (np.concatenate([h * MIX, two, skip]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    at: np.ndarray  # the buckets with a weight
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BITS, np.float32)
        full[self.at] = self.weight
        return full


def fit(texts: list[str | None], labels: list[int], **options) -> Model:
    """``fit_bags`` on whole texts."""
    return fit_bags([np.unique(features(t or "")) for t in texts], labels, **options)


def fit_bags(bags: list[np.ndarray], labels: list[int], *, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5, epochs: int = 6, seed: int = 0) -> Model:
    """FTRL-proximal on rows of distinct buckets; without rows a model that gives 0.5 to all."""
    z, n, b, nb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, y = bags[i], labels[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            nb += g * g
            b -= alpha * g / (beta + np.sqrt(nb))
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return Model(at.astype(np.int32), w[at].astype(np.float32), float(b))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: F.Column | None = None, sample_rows: int = 8000, seed: int = 0) -> Model:
    """Fits on at most ``sample_rows`` labelled documents, both classes as even as their counts allow.

    A document with several labels counts as toxic if one says so; null labels and ids are left out, and so are null
    texts. Of several texts of an id the first in order counts. ``learn`` sees the column id. The driver gets the rows'
    buckets, not their texts: 2**18 for a row at most. Without labels or documents every score is 0.5.
    """
    want = common.pick(labels, id=id_col, label=label_col).where("id IS NOT NULL AND label IS NOT NULL")
    want = (want if learn is None else want.where(learn)).groupBy("id").agg(F.max("label").alias("label"))
    want = common.bounded_sample(want, "id", "label", sample_rows, seed)
    texts = common.pick(docs, id=id_col, text=text_col).where("text IS NOT NULL")
    got = texts.join(F.broadcast(want), "id").groupBy("id").agg(F.min_by(F.struct("text", "label"), "text").alias("x")).select(F.col("id").cast("string").alias("id"), "x.text", F.col("x.label").cast("int").alias("label"))  # want: sample_rows rows at most

    def bags(batches):
        for batch in common.slices(batches):
            made = [zlib.compress(np.diff(np.unique(features(t)), prepend=0).astype(np.int32).tobytes(), 1) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["id", "label", "at"])

    got = got.mapInArrow(bags, "id STRING, label INT, at BINARY").collect()
    got.sort(key=lambda r: r["id"])
    return fit_bags([np.frombuffer(zlib.decompress(r["at"]), np.int32).cumsum() for r in got], [r["label"] for r in got], seed=seed)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Appends toxicity (0 to 1) to every row.

    Null and empty texts get the bias alone; texts of any length are read whole. An empty table stays empty. Rows stand alone, so repeats and order don't matter; other columns pass
    through, and an input that has ``toxicity`` already is a ValueError.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 weights at most, whatever the corpus
    if any(c.lower() == "toxicity" for c in docs.columns):
        raise ValueError("the input already has toxicity")
    kept: dict = {}

    def rows(texts):
        if "w" not in kept:
            kept["w"], kept["b"] = held.value.table(), held.value.bias
        w, out = kept["w"], []
        for t in texts:
            at = features(t) if t else np.zeros(0, np.int64)
            at = np.unique(at[w[at] != 0])
            out.append(float(1 / (1 + np.exp(-np.clip(float(w[at].sum(dtype=np.float64)) + kept["b"], -35, 35)))))
        return [out]

    return common.per_text(docs, text_col, [("toxicity", T.DoubleType())], rows)
