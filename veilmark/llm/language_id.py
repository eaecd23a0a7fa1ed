"""Language identification by multinomial naive Bayes over hashed character n-grams.

Tasks count hashed n-grams of one to three characters by language; the counts are summed by Spark over the whole
training part. The log-probability matrix is broadcast, 96 KB for each language of the training rows, and tasks score
their texts by gathering and summing its columns. N-grams begin within their text, so a score depends on the text alone.

Null and empty texts and texts without a letter are ``und`` with score 0; ties go to the first language in order;
without training rows everything is ``und``, texts with letters too. Repeated rows each get their row. Input columns named
``lang_pred`` or ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import bound_batches

BITS, ORDERS = 13, (1, 2, 3)
ALPHA = 0.5
UNKNOWN = "und"


def _buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each order at each place, the places that count, and where each text starts."""
    texts = [t.lower() for t in texts]
    c, starts = features.codes(texts)
    return [features.char_ngrams(c, n, BITS) + np.uint32(i << BITS) for i, n in enumerate(ORDERS)], features.inside(texts, starts, len(c)), starts


def count_ngrams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, bucket, n over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                total = found.setdefault(lang, np.zeros(len(ORDERS) << BITS, dtype=np.int64))
                for a, b in features.blocks(texts):
                    hashes, own, _ = _buckets(texts[a:b])
                    for h in hashes:
                        total += np.bincount(h[own], minlength=len(total))
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    bound_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, one row for each bucket."""
    langs = sorted(r[0] for r in docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col).distinct().collect())
    counts = np.zeros((max(len(langs), 1), len(ORDERS) << BITS))
    if langs:
        t = count_ngrams(docs, lang_col, text_col).toArrow()
        row = np.searchsorted(np.array(langs), np.array(t["lang"].to_pylist(), dtype=str))
        counts[row, t["bucket"].to_numpy()] = t["n"].to_numpy()
    return langs, np.log((counts + ALPHA) / (counts + ALPHA).sum(axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score (posterior of the predicted language)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(others)).to_pylist()]
            preds, scores = [], []
            for a, b in features.blocks(texts):
                hashes, own, starts = _buckets(texts[a:b])
                total = np.array([sum(np.add.reduceat(np.where(own, row[h], np.float32(0)), starts, dtype=np.float64) for h in hashes) for row in logp])
                best = total.argmax(axis=0)
                post = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
                for text, k, p in zip(texts[a:b], best, post, strict=True):
                    known = bool(langs) and any(map(str.isalpha, text))
                    preds.append(langs[k] if known else UNKNOWN)
                    scores.append(float(p) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*others, "lang_pred", "score"])

    kept = docs.select(*others, text_col)
    schema = kept.select(*others, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return kept.mapInArrow(score, schema)


def op2_language_id(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
