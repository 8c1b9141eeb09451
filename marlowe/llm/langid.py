"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every 3- and 4-byte window of a lower-cased text is hashed to a row of an embedding table; a text is the
average of its rows, and a linear softmax gives the languages' probabilities. Table and softmax are trained
together by stochastic gradient descent in numpy. As both are linear, training ends with their product, a
``buckets x languages`` table, so that scoring is one gather and one mean. A temperature and a rejection
threshold are calibrated on labelled rows that the descent has not seen.
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

BITS = 16
UNKNOWN = "und"
MULTIPLIER = np.uint32(0x9E3779B1)
CHUNK = 1 << 19
#: ASCII bytes that aren't letters count as spaces; other bytes stay.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def subwords(text: str, bits: int) -> np.ndarray:
    """Bucket numbers of the 3- and 4-byte windows, words set off by single spaces."""
    b = FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]].astype(np.uint32)
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16) if b.size > 2 else b[:0]
    four = three[:-1] | b[3:] << np.uint32(24) if b.size > 3 else b[:0]
    shift = np.uint32(32 - bits)
    return np.concatenate([(three * MULTIPLIER) >> shift, ((four ^ np.uint32(0x5BD1E995)) * MULTIPLIER) >> shift])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x langs: embeddings times softmax weights
    bias: np.ndarray
    bits: int
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        h = subwords(text, self.bits)
        total = np.zeros(len(self.langs), np.float64)
        for i in range(0, h.size, CHUNK):
            total += self.table[h[i : i + CHUNK]].sum(axis=0, dtype=np.float64)
        return total / max(1, h.size) + self.bias

    def of_bag(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return n @ self.table[at].astype(np.float64) / max(1, n.sum()) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bag(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords and how many fall into each: 2**bits of them at most, however long the text."""
    at, n = np.unique(subwords(text, bits), return_counts=True)
    return at.astype(np.int32), n.astype(np.int32)


def fit(texts: list[str], langs: list[str], **options) -> Model | None:
    """``fit_bags`` on whole texts."""
    rows = [(*bag(t), y) for t, y in zip(texts, langs, strict=True) if t and y is not None and any(map(str.isalpha, t))]
    return fit_bags(rows, **options)


def fit_bags(rows: list[tuple[np.ndarray, np.ndarray, str]], *, bits: int = BITS, dim: int = 16, epochs: int = 5, rate: float = 0.5, rejected: float = 0.001, seed: int = 0) -> Model | None:
    """Trains on four fifths of the rows (buckets, counts, language) and calibrates on the others; None without rows.

    rejected: the share of calibration rows that may fall below the threshold, which is 0.5 at most. A single row is
    both. The model has 2**bits numbers for each language, 256 KB.
    """
    if not rows:
        return None
    names = sorted({y for _, _, y in rows})
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = -(-len(rows) // 5)
    kept, learn = rows[:held], rows[held:] or rows
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    bags = []
    for at, n, y in learn:
        bags.append((at, (n / n.sum()).astype(np.float32), names.index(y)))
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, share, y = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            x = share @ emb[at]
            g = softmax(x @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= lr * np.outer(x, g)
            bias -= lr * 0.1 * g
            emb[at] -= lr * np.outer(np.minimum(share * at.size, 8.0), back)
    model = Model(names, emb @ out, bias, bits, 1.0, 0.0)
    logits, truth = np.array([model.of_bag(at, n) for at, n, _ in kept]), np.array([names.index(y) for _, _, y in kept])
    grid = np.geomspace(0.05, 20, 60)
    # smoothed targets, else rows that are all right would call for a temperature of zero
    slack = 1 / (np.bincount(truth, minlength=len(names)) + 2)[truth]
    target = np.full(logits.shape, 1.0) * (slack / max(1, len(names) - 1))[:, None]
    target[np.arange(len(truth)), truth] = 1 - slack
    nll = [-(target * np.log(softmax(logits / s) + 1e-12)).sum(axis=1).mean() for s in grid]
    model.temperature = float(grid[int(np.argmin(nll))])
    best = softmax(logits / model.temperature).max(axis=1)
    model.threshold = float(min(0.5, np.quantile(best, rejected)))
    return model


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: F.Column | None = None, sample_rows: int = 4000, seed: int = 0) -> Model | None:
    """Fits on at most ``sample_rows`` labelled rows, spread over the languages by the key's hash.

    ``learn`` restricts them further; it sees the columns id, text and lang. The driver gets the rows' buckets and
    counts, not their texts: 2**16 of either for a row at most. Null ids, texts and languages, texts without a letter and
    an empty table teach nothing; repeated rows count each; other columns are left out.
    """
    rows = common.pick(docs, id=id_col, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    rows = rows if learn is None else rows.where(learn)

    def bags(batches):
        for batch in common.slices(batches):
            texts = batch.column(0).to_pylist()
            made = [bag(t) if any(map(str.isalpha, t)) else None for t in texts]
            parts = [pa.array([m and zlib.compress(m[k].astype(kind).tobytes(), 1) for m in made], pa.binary()) for k, kind in ((0, np.uint16), (1, np.int32))]  # most counts are 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (1, 2, 3)), *parts], names=["id", "lang", "_draw", "at", "n"])

    def made(some: DataFrame) -> DataFrame:
        return some.select("text", F.col("id").cast("string").alias("id"), "lang", "_draw").mapInArrow(bags, f"id STRING, lang {rows.schema['lang'].dataType.simpleString()}, _draw DOUBLE, at BINARY, n BINARY")

    got = common.bounded_sample(rows, "id", "lang", sample_rows, seed, made).collect()
    got.sort(key=lambda r: (r["id"], r["at"] or b"", r["n"] or b""))
    return fit_bags([(np.frombuffer(zlib.decompress(r["at"]), np.uint16), np.frombuffer(zlib.decompress(r["n"]), np.int32), r["lang"]) for r in got if r["at"]], seed=seed)


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """Appends lang_pred, lang_score and lang_accepted to every row.

    A null or empty text, one without any letter, and any text when there is no model get ``und``, 0.0 and false.
    A score below the model's threshold keeps its language but isn't accepted. Each row stands alone, so repeated
    rows and ties between rows don't matter, and texts of any length are read whole; of equal probabilities the first language in sorted order wins.
    Other columns pass through; an input that has the three names already is a ValueError.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB a language, whatever the corpus

    def rows(texts):
        m = held.value
        got = [m.predict(t) if m else (UNKNOWN, 0.0, False) for t in texts]
        return [[g[i] for g in got] for i in range(3)]

    new = ["lang_pred", "lang_score", "lang_accepted"]
    if clash := [c for c in docs.columns if c.lower() in new]:
        raise ValueError(f"the input already has {clash}")
    return common.per_text(docs, text_col, list(zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)), rows)
