import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderworks.llm.toxicity import _MIN_ROWS, _ROUNDS, BITS, FOLDS, WIDTH, features, fit_chain, predict_chain, score, train

SCHEMA = "doc_id bigint, text string, p_toxic string, _row string"


def texts(n=240, seed=1):
    r = random.Random(seed)
    out, marks = [], []
    for i in range(n):
        w = [f"w{r.randint(0, 90)}" for _ in range(r.randint(1, 40))]
        bad, rude = i % 4 == 0, i % 3 == 0
        if bad:
            w.append("dull" + r.choice("ab"))
        if rude:
            w.insert(r.randrange(len(w)), "vile" + r.choice("abc"))
        out.append(" ".join(w))
        marks.append((int(bad), int(rude or (bad and r.random() < 0.5))))
    return out, np.array(marks)


def dense_fit(x, earlier, label):
    """The same model over a dense table: features by their gain, then steps of full gradients."""
    n = len(label)
    share = (label.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if label.min() == label.max():
        return lambda a, e: np.full(len(a), 1 / (1 + np.exp(-bias)))
    total, hit = x.sum(0), label @ x
    expected = total * label.mean()
    gain = np.where(total >= _MIN_ROWS, (hit - expected) ** 2 / np.maximum(expected * (1 - total / (n + 1)), 1e-9), 0)
    best = [k for k in sorted(range(x.shape[1]), key=lambda k: (-gain[k], k))[:WIDTH] if gain[k] > 6]
    z = np.hstack([x[:, best], earlier, np.ones((n, 1))])
    w, square = np.zeros(z.shape[1]), np.full(z.shape[1], 1e-8)
    w[-1] = bias
    decay = np.full(z.shape[1], 1e-5)
    decay[-1] = 0
    for _ in range(_ROUNDS):
        g = z.T @ ((1 / (1 + np.exp(-(z @ w))) - label) / n) + decay * w
        square += g * g
        w -= 0.5 * g / np.sqrt(square)
    return lambda a, e: 1 / (1 + np.exp(-(np.hstack([a[:, best], e, np.ones((len(a), 1))]) @ w)))


def dense_chain(found, fold, marks):
    names = sorted({int(v) for f in found for v in f})
    x = np.zeros((len(found), len(names)))
    for i, f in enumerate(found):
        x[i, np.searchsorted(names, f)] = 1
    earlier, models = np.zeros((len(found), 0)), []
    for c in range(marks.shape[1]):
        label, held_out = marks[:, c].astype(float), np.zeros(len(found))
        for k in range(FOLDS):
            model = dense_fit(x[fold != k], earlier[fold != k], label[fold != k])
            held_out[fold == k] = model(x[fold == k], earlier[fold == k])
        models.append(dense_fit(x, earlier, label))
        earlier = np.column_stack([earlier, held_out])
    p = np.zeros((len(found), 0))
    for m in models:
        p = np.column_stack([p, m(x, p)])
    return p


def test_chain_against_a_dense_version():
    own, marks = texts()
    found = list(features([t.encode() for t in own]))
    fold = np.array([i * 7 % 11 % FOLDS for i in range(len(own))])
    got = predict_chain(fit_chain(found, fold, marks), [t.encode() for t in own])
    assert np.allclose(got, dense_chain(found, fold, marks), atol=1e-6) and BITS == 20
    assert ((got[:, 1] >= 0.5) == marks[:, 1]).mean() > 0.85


def test_later_models_see_earlier_probabilities():
    own, marks = texts(400, 3)
    found = list(features([t.encode() for t in own]))
    fold = np.arange(len(own)) % FOLDS
    chain = fit_chain(found, fold, np.stack([marks[:, 0], marks[:, 0] | marks[:, 1]], 1))
    assert len(chain[0].earlier) == 0 and len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_training_on_odd_rows(spark, kind):
    own, marks = texts(300)
    rows = [(i, t, "old", "r") for i, t in enumerate(own)] + [(1, own[1], "old", "r")] * 2 + [(1000, None, "old", "r"), (1001, "", "old", "r"), (None, own[2], "old", "r"), (1002, "vilea " * 50000, "old", "r")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
    known = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(marks)] + [(1, 0, 0), (1000, 0, 1), (None, 1, 1), (2, None, 1)], "doc_id bigint, low int, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    chains = [train(d, known, ["low", "toxic"]) for d in (docs, docs.repartition(5))]
    assert all(np.array_equal(a.chosen, b.chosen) and np.allclose(a.weights, b.weights) for a, b in zip(*chains, strict=True))
    got = score(docs, chains[0], ["low", "toxic"])
    assert got.columns == ["doc_id", "_row", "p_low", "p_toxic"] and got.count() == len(rows)
    p = {r.doc_id: r.p_toxic for r in got.collect()}
    key = (lambda i: str(i)) if kind == "string" else (lambda i: i)
    assert p[key(1002)] > 0.5 and p[key(1000)] == p[key(1001)] and all(0 <= v <= 1 for v in p.values())
    assert score(docs.limit(0), chains[0], ["low", "toxic"]).collect() == []
    few = train(docs, known, ["low", "toxic"], sample=50)
    assert len(few) == 2
