"""Quality classifier: supervised subword embeddings.

A document is the average of the vectors of its hashed words and character n-grams; a softmax layer over that average
gives the classes. Shards of a bounded sample of labelled rows are trained in parallel tasks by stochastic gradient
descent in numpy; the model is the mean of the shards' class scores for each bucket, which is exact as the score is
linear in the average. Scoring gathers one number for each feature.

``MAX_TRAIN`` bounds the sample's rows (lowest hashes of the identifiers, so it is the same at each run). Null and empty texts
have no features and get the score of the bias; an identifier with several texts, or with both labels, counts with each, and repeated
rows and labels count once; without labels of both
classes every score is the share of label 1, or 0.5 with none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import bound_batches, give_back, materialize

BITS, ORDERS = 14, (2, 3, 4)
SIZE = (len(ORDERS) + 1) << BITS
#: Labelled rows used at most, shards they are dealt to, and the training's settings.
MAX_TRAIN, SHARDS = 8_000, 4
DIM, EPOCHS, RATE, SEED = 8, 6, 1.0, 7


def _features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order, buckets and the text each belongs to by its start."""
    c, starts = features.codes(texts)
    parts = [(features.char_ngrams(c, n, BITS) + np.uint32(i << BITS), None) for i, n in enumerate(ORDERS)]
    words, begins = features.word_hashes(c, BITS)
    return [p for p, _ in parts], [starts, words + np.uint32(len(ORDERS) << BITS), np.searchsorted(begins, starts), c]


def train_shard(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Score of label 1 against 0 for each bucket, and the bias."""
    rows = []
    for t in texts:
        grams, (_, words, _, _) = _features([t])
        inside = len(t)
        found = np.concatenate([*[g[:inside] for g in grams], words])
        ids, n = np.unique(found, return_counts=True)
        rows.append((ids, (n / max(len(found), 1)).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (SIZE, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, step = EPOCHS * len(rows), 0
    weight = np.array([len(labels) / (2 * max((labels == k).sum(), 1)) for k in (0, 1)], dtype=np.float32)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, w = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = w @ emb[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            grad = p / p.sum()
            grad[labels[i]] -= 1
            grad *= weight[labels[i]]
            back = grad @ out
            out -= rate * np.outer(grad, hidden)
            bias -= 0.1 * rate * grad
            # the step of a vector follows its share; the factor evens out the length of the text
            emb[ids] -= rate * np.minimum(w * len(ids), 5.0)[:, None] * back[None, :] * 0.05
    return (emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray | None, float]:
    """Fit on at most MAX_TRAIN labelled rows of ``docs``."""
    rows = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    # rows are drawn without their texts; a text that stands several times under one identifier is one row
    drawn = texts.select("id", "key").join(rows, "id").groupBy("id", "key", "y").agg(F.count("*").alias("n")).orderBy(F.xxhash64("id"), "id", "key", "y").limit(MAX_TRAIN)
    sample = materialize(drawn.select("id", "key", "y"))
    picked = texts.join(F.broadcast(sample), ["id", "key"]).dropDuplicates(["id", "key", "y"])
    picked = picked.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard"), F.coalesce("text", F.lit("")).alias("text"), "y", "id", "key")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("key", "ascending"), ("y", "ascending")])
        y = table["y"].to_numpy().astype(np.int64)
        one = float(y.mean())
        scores, bias = train_shard(table["text"].to_pylist(), y) if 0 < one < 1 else (np.zeros(SIZE, np.float32), float(np.log((one + 1e-3) / (1 - one + 1e-3))))
        return pa.table({"scores": pa.array([scores.tobytes()], pa.binary()), "bias": [bias], "n": pa.array([len(y)], pa.int64())})

    found = picked.groupBy("shard").applyInArrow(train, "scores binary, bias double, n long").collect()
    if not found:
        return None, 0.0
    total = sum(r["n"] for r in found)
    scores = sum(np.frombuffer(bytes(r["scores"]), np.float32).astype(np.float64) * r["n"] for r in found) / total
    return scores.astype(np.float32), sum(r["bias"] * r["n"] for r in found) / total


def predict(docs: DataFrame, model: tuple[np.ndarray | None, float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; a column of that name is replaced."""
    docs = docs.drop("score")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            scores = np.full(len(texts), bias)
            if weights is not None:
                for a, b in features.blocks(texts):
                    grams, (starts, words, first, c) = _features(texts[a:b])
                    inside = features.inside(texts[a:b], starts, len(c)).astype(np.float32)
                    lengths = np.array([len(t) for t in texts[a:b]])
                    total = sum(np.add.reduceat(weights[g] * inside, starts, dtype=np.float64) for g in grams)
                    n = lengths * float(len(ORDERS))
                    sums = np.concatenate(([0.0], np.cumsum(weights[words], dtype=np.float64)))
                    last = np.append(first[1:], len(words))
                    total += sums[last] - sums[first]
                    n += last - first
                    scores[a:b] += total / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(scores, -60, 60))))], names=[*names, "score"])

    return docs.mapInArrow(lambda batches: give_back(run(batches)), docs.withColumn("score", F.lit(0.0)).schema)


def op10_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs, labels.where(~held_out))
    rows = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
