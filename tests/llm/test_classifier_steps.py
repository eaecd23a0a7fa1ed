"""The quality classifier step by step against plain loops, and the bound of its sample."""

import math

import numpy as np
import pytest

from veilmark.llm import quality_classifier as q


def plain_features(text):
    """Buckets of a text's features, each as often as it stands there."""
    grams, (_, words, _, _) = q._features([text])
    return [int(b) for g in grams for b in g[: len(text)]] + [int(b) for b in words]


def plain_training(texts, labels):
    """One shard trained by loops over numbers; only the random start and order are numpy's."""
    rows = []
    for t in texts:
        found = plain_features(t)
        rows.append({b: found.count(b) / max(len(found), 1) for b in sorted(set(found))})
    rng = np.random.default_rng(q.SEED)
    emb = [list(map(float, v)) for v in rng.uniform(-1 / q.DIM, 1 / q.DIM, (q.SIZE, q.DIM)).astype(np.float32)]
    out, bias = [[0.0] * q.DIM for _ in range(2)], [0.0, 0.0]
    step = 0
    for _ in range(q.EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = q.RATE * (1 - step / (q.EPOCHS * len(rows)))
            step += 1
            hidden = [sum(w * emb[b][d] for b, w in rows[i].items()) for d in range(q.DIM)]
            z = [sum(out[k][d] * hidden[d] for d in range(q.DIM)) + bias[k] for k in (0, 1)]
            p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
            grad = [(p[k] - (labels[i] == k)) * len(labels) / (2 * max(list(labels).count(labels[i]), 1)) for k in (0, 1)]
            back = [sum(grad[k] * out[k][d] for k in (0, 1)) for d in range(q.DIM)]
            for k in (0, 1):
                bias[k] -= 0.1 * rate * grad[k]
                for d in range(q.DIM):
                    out[k][d] -= rate * grad[k] * hidden[d]
            for b, w in rows[i].items():
                for d in range(q.DIM):
                    emb[b][d] -= rate * min(w * len(rows[i]), 5.0) * back[d] * 0.05
    return [sum(v[d] * (out[1][d] - out[0][d]) for d in range(q.DIM)) for v in emb], bias[1] - bias[0]


def test_a_shard_is_trained_as_plain_loops_do():
    texts, labels = ["good words here", "x# %% x# %%", "more good words", "", "%% junk #"], np.array([1, 0, 1, 1, 0])
    scores, bias = q.train_shard(texts, labels)
    want, want_bias = plain_training(texts, labels)
    assert bias == pytest.approx(want_bias, abs=1e-4)
    for b in {b for t in texts for b in plain_features(t)}:
        assert scores[b] == pytest.approx(want[b], abs=1e-4)


def test_scores_are_the_mean_of_the_features(spark):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=q.SIZE).astype(np.float32)
    texts = ["a few words", "", None, "é 日本 word word", "x", " ", "a few words"]
    rows = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: r["score"] for r in q.predict(rows, (weights, 0.25)).collect()}
    for i, t in enumerate(texts):
        found = plain_features(t) if t else []
        mean = sum(float(weights[b]) for b in found) / max(len(found), 1)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(0.25 + mean))), abs=1e-5)


def test_rows_of_the_sample_are_bounded(spark, monkeypatch):
    """Many rows of one identifier cannot fill a task: rows are bounded, not identifiers, and only labelled documents are drawn."""
    monkeypatch.setattr(q, "MAX_TRAIN", 40)
    docs = spark.createDataFrame([(1, f"text {i} of one") for i in range(500)] + [(2, "the same")] * 300 + [(i, f"other {i}") for i in range(3, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), *[(i, i % 2) for i in range(3, 30)], (99, 1), (None, 1)], "doc_id long, quality int")
    seen = []
    plain = q.materialize
    monkeypatch.setattr(q, "materialize", lambda df: seen.append(plain(df)) or seen[-1])
    weights, _ = q.fit(docs, labels)
    assert weights is not None and [x.count() for x in seen] == [40]
    assert seen[0].where("doc_id = 99" if "doc_id" in seen[0].columns else "id = 99").count() == 0 and seen[0].where("id = 2").count() <= 1
