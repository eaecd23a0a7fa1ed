"""Corpus pipeline: quality classifier, near duplicates, decontamination, personal data, tokens.

Each stage takes what its predecessor kept and returns documents; the last returns token ids. ``run`` writes every
stage to the shared folder and reads it back, so that a lost executor costs no more than its own stage's tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import byte_bpe, decontamination, jaccard_join, pii, quality_classifier
from veilmark.llm.common import Scratch, materialize, remove, table

#: Rows to drop, 24 bytes each, are broadcast up to this number (some 10 MB with the hash table); more are joined by a shuffle.
MAX_BROADCAST_IDS = 150_000


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, which tells rows apart by identifier and text (a digest of 128 bits): equal rows have one."""
    return docs.withColumn("_row", F.struct(*jaccard_join.row_key()))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, without those that ``rows`` names."""
    rows = materialize(rows.select("_row").distinct())
    return docs.join(F.broadcast(rows) if rows.count() <= MAX_BROADCAST_IDS else rows, "_row", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; it learns from the rows that its query learns from."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = quality_classifier.fit(docs, labels)
    return quality_classifier.predict(docs, model).where(F.col("score") >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id (null last) of each group of linked documents, and one row of repeated ones."""
    rows = _numbered(docs)
    with Scratch() as scratch:
        linked = jaccard_join.linked_rows(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_row.*", "text"), scratch)
        found = scratch.result(linked.select("doc_id", F.struct("doc", "key").alias("_row"), "component"))
    # only groups of several rows are looked at again, without their texts
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    groups = found.where("component is not null").groupBy("component").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    kept = _without(rows, found.join(groups, "component").where("_row <> first._row"))
    times = materialize(found.groupBy("_row").count().where("count > 1").select("_row"))
    few = F.broadcast(times) if times.count() <= MAX_BROADCAST_IDS else times
    once = kept.join(few, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.join(few, "_row", "left_anti").unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    rows = _numbered(docs)
    found = decontamination.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    return _without(rows, found.select(F.col("doc_id").alias("_row"))).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the new text."""
    cleaned = pii.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (little-endian unsigned 32-bit) and whether decoding gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, decoded=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", F.expr("cast(length(token_ids) / 4 as bigint)").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL cannot express the trained classifier and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has written besides its result is removed when it ends, its input when the next has ended."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with Scratch() as scratch:
            docs = scratch.result(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = scratch.kept[1]
    return docs
