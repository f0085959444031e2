"""Toxicity by a classifier chain: one linear model for each category, in a fixed order; each later model also sees the
probabilities that earlier ones give.

While training, those probabilities come from models that haven't seen the row (out-of-fold), so that a later model
learns from such values as it will meet. Features are the distinct words of a text and the stems (first ``STEM``
characters) of its words, hashed to ``BITS`` bits. A model keeps the ``WIDTH`` features that tell its category best.

Models are fitted on at most ``sample`` labelled rows, taken in the order of a hash; all else covers all rows. The
fitted chain has a fixed size and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.llm.frames import packed, row_field, unpacked
from ladderworks.llm.words import ALNUM, mix, pieces, split_words

BITS = 20
WIDTH = 4096
STEM = 4
FOLDS = 3
_ROUNDS = 60
_MIN_ROWS = 3


def features(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Distinct hashed features of every text."""
    mask = np.uint64((1 << BITS) - 1)
    for lo, hi in pieces(texts):
        words = split_words(texts[lo:hi], ALNUM, lower=True)
        n = len(words.starts)
        padded = np.concatenate([words.buf, np.zeros(STEM * 4, np.uint8)])
        stem = np.full(n, 1, np.uint64)
        length = words.ends - words.starts
        for k in range(STEM):  # bytes: a stem of characters outside ASCII is shorter
            stem = mix(stem ^ np.where(k < length, padded[words.starts + k].astype(np.uint64) + np.uint64(1), 0).astype(np.uint64))
        both = np.stack([words.hashes & mask, (stem & mask)], 1)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            yield np.unique(both[a:b])


@dataclass
class Linear:
    """A logistic model over chosen features and the chain's earlier probabilities."""

    chosen: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    @classmethod
    def fit(cls, row: np.ndarray, feature: np.ndarray, n: int, earlier: np.ndarray, label: np.ndarray) -> Linear:
        """(row, feature) are the set entries; a label with one class gives a constant."""
        share = (label.sum() + 0.5) / (n + 1)
        if label.min(initial=1) == label.max(initial=0) or not len(row):
            return cls(np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
        total = np.bincount(feature, minlength=1 << BITS)
        hit = np.bincount(feature, weights=label[row], minlength=1 << BITS)
        expected = total * label.mean()
        gain = np.where(total >= _MIN_ROWS, (hit - expected) ** 2 / np.maximum(expected * (1 - total / (n + 1)), 1e-9), 0)
        best = np.argsort(-gain, kind="stable")[:WIDTH]
        chosen = np.sort(best[gain[best] > 6])
        at = np.minimum(np.searchsorted(chosen, feature), max(0, len(chosen) - 1))
        use = chosen[at] == feature if len(chosen) else np.zeros(len(feature), bool)
        row, col = row[use], at[use]
        w, v, b = np.zeros(len(chosen)), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share)))
        square = [np.full(len(chosen), 1e-8), np.full(earlier.shape[1], 1e-8), 1e-8]
        for _ in range(_ROUNDS):  # full gradients, each weight at its own pace
            p = _sigmoid(b + earlier @ v + np.bincount(row, weights=w[col], minlength=n))
            e = (p - label) / n
            g = [np.bincount(col, weights=e[row], minlength=len(chosen)) + 1e-5 * w, earlier.T @ e + 1e-5 * v, float(e.sum())]
            square = [s + x * x for s, x in zip(square, g, strict=True)]
            w, v, b = w - 0.5 * g[0] / np.sqrt(square[0]), v - 0.5 * g[1] / np.sqrt(square[1]), b - 0.5 * g[2] / np.sqrt(square[2])
        return cls(chosen, w, v, float(b))

    def predict(self, row: np.ndarray, feature: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        score = np.full(n, self.bias) + earlier @ self.earlier
        if len(self.chosen) and len(row):
            at = np.minimum(np.searchsorted(self.chosen, feature), len(self.chosen) - 1)
            use = self.chosen[at] == feature
            score += np.bincount(row[use], weights=self.weights[at[use]], minlength=n)
        return _sigmoid(score)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _entries(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the set entries."""
    return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.empty(0, np.int64), *(np.asarray(f).astype(np.int64) for f in found)])


def fit_chain(found: list[np.ndarray], fold: np.ndarray, labels: np.ndarray) -> list[Linear]:
    """One model a column of ``labels``, in order, from the rows' features."""
    row, feature = _entries(found)
    n, earlier, chain = len(found), np.zeros((len(found), 0)), []
    for c in range(labels.shape[1]):
        label = labels[:, c].astype(float)
        held_out = np.zeros(n)
        for k in range(FOLDS):
            inside, place = fold == k, np.cumsum(fold == k) - 1
            outside, other = ~inside, np.cumsum(fold != k) - 1
            mine = inside[row]
            model = Linear.fit(other[row[~mine]], feature[~mine], int(outside.sum()), earlier[outside], label[outside])
            held_out[inside] = model.predict(place[row[mine]], feature[mine], int(inside.sum()), earlier[inside])
        chain.append(Linear.fit(row, feature, n, earlier, label))
        earlier = np.column_stack([earlier, held_out])
    return chain


def predict_chain(chain: list[Linear], texts: list[bytes | None]) -> np.ndarray:
    row, feature = _entries(list(features(texts)))
    earlier = np.zeros((len(texts), 0))
    for model in chain:
        earlier = np.column_stack([earlier, model.predict(row, feature, len(texts), earlier)])
    return earlier


_MODEL = "category int, chosen binary, weights binary, earlier binary, bias double"


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = 8192) -> list[Linear]:
    """Fits the chain on at most ``sample`` labelled rows, those of the smallest hash of the id.

    Rows without an id, a text or one of the labels aren't used; of repeated ids, each joined row counts. Without
    usable rows every category has the constant probability of 1/2.
    """
    wanted = [F.col(f"`{c}`").cast("int").alias(f"_{k}") for k, c in enumerate(categories)]
    marks = [f"_{k}" for k in range(len(categories))]
    own = labels.select(F.col(f"`{id_col}`").alias("_id"), *wanted).dropna().orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).dropna().join(F.broadcast(own), "_id")
    rows = rows.select(F.xxhash64("_id", F.lit(7)).alias("_order"), F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("_fold"), *marks, "_text")
    # Texts of any length become their distinct features where they are; the fitting task sees no text.
    schema = ", ".join(["_order bigint, _fold int", *(f"{m} int" for m in marks), "_features array<int>"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype(np.int32) for f in features(batch.column("_text").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("_order", "_fold", *marks)} | {"_features": pa.array(found, pa.list_(pa.int32()))})

    rows = rows.mapInArrow(featured, schema).orderBy("_order", "_fold", *marks, "_features").limit(sample)

    def fit(table: pa.Table) -> pa.Table:
        fold = table.column("_fold").to_numpy().astype(np.int64)
        own = np.stack([table.column(m).to_numpy() for m in marks], 1)
        found = [x.values.to_numpy() for x in table.column("_features")]
        chain = fit_chain(found, fold, own)
        out = [(k, m.chosen.astype("<i8").tobytes(), m.weights.astype("<f8").tobytes(), m.earlier.astype("<f8").tobytes(), m.bias) for k, m in enumerate(chain)]
        return pa.table(dict(zip(("category", "chosen", "weights", "earlier", "bias"), map(list, zip(*out, strict=True)), strict=True)), schema=pa.schema([("category", pa.int32()), ("chosen", pa.binary()), ("weights", pa.binary()), ("earlier", pa.binary()), ("bias", pa.float64())]))

    fitted = sorted(rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(fit, _MODEL).collect())
    if not fitted:
        return [Linear(np.empty(0, np.int64), np.empty(0), np.zeros(k), 0.0) for k in range(len(categories))]
    return [Linear(np.frombuffer(r.chosen, "<i8"), np.frombuffer(r.weights, "<f8"), np.frombuffer(r.earlier, "<f8"), r.bias) for r in fitted]


def score(docs: DataFrame, chain: list[Linear], categories: list[str], text_col: str = "text") -> DataFrame:
    """The documents without their text, and ``p_<category>`` for each category.

    * A null or empty text has no features; it gets the models' bias. Whole texts count, whatever their length.
    * Repeated rows each have their own result; an empty table gives an empty table.
    * Input columns of the names of the results are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in categories]
    schema = T.StructType([row_field(docs, text_col), *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            parts = [predict_chain(held.value, texts[lo:hi]) for lo, hi in pieces(texts)]
            p = np.concatenate([np.empty((0, len(names))), *parts])
            yield pa.RecordBatch.from_pydict({"_row": batch.column("_row")} | {c: pa.array(p[:, k], pa.float64()) for k, c in enumerate(names)})

    scored = packed(docs, text_col).mapInArrow(run, schema)
    return unpacked(scored, docs, text_col, None, **{c: F.col(c) for c in names})
