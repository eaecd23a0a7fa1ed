"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size. An item with at most ``n`` shingles in its partition is sketched by its ``k`` first
shingles in the order of (number of items that have it, hash), a bottom-k MinHash in which passages that many items share come last, with ``k > (1 - threshold) * n``: a document that contains the item to the
threshold misses fewer than ``k`` shingles, so at least one shingle of the sketch is in the document, however long the
document is. The search therefore loses nothing; its candidates are verified by counting exactly how many of the
item's shingles the document holds. Only the texts of candidates are split a second time.

Shingles are five words (an item with fewer is one shingle, found as a window of as many words). Only DataFrame
functions are used. Items without words match nothing; null texts are empty; repeated items and rows do no harm. Each text is
judged by itself: an identifier with several texts holds an item if one of them does, and counts the most that one of them holds.
Documents and items with a null identifier are left out, as no pair could name them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import full_gram_hashes, gram_hashes, lower_words, materialize

SHINGLE, THRESHOLD = 5, 0.8
#: Rows of at most 40 bytes are broadcast up to this number (10 MB); beyond it the join shuffles.
MAX_BROADCAST_ROWS = 250_000


def item_shingles(items: DataFrame, threshold: float = THRESHOLD, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct shingles of each item: item_id, item_key (hash of its text), width (words a shingle), n (set size), h, in_sketch."""
    named = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.xxhash64(text_col).alias("item_key"), lower_words(F.col(text_col)).alias("words")).dropDuplicates(["item_id", "item_key"])
    sets = named.select("item_id", "item_key", F.least(F.size("words"), F.lit(SHINGLE)).alias("width"), F.array_distinct(full_gram_hashes(F.col("words"), SHINGLE)).alias("g"))
    # partitions double in size; k is the same for all items of a partition
    sets = sets.select("item_id", "item_key", "width", "g", F.size("g").alias("n"), F.pow(2, F.ceil(F.log2(F.greatest(F.size("g"), F.lit(1))))).cast("int").alias("upper"))
    sets = sets.withColumn("k", F.floor((1 - threshold) * F.col("upper") + 1e-9).cast("int") + 1)
    rows = materialize(sets.select("item_id", "item_key", "width", "n", "k", F.explode_outer("g").alias("h")).where("h is not null"))
    shared = rows.groupBy("width", "h").agg(F.count("*").alias("items"))
    place = F.row_number().over(Window.partitionBy("item_id", "item_key").orderBy("items", "h"))
    return rows.join(shared, ["width", "h"]).select("item_id", "item_key", "width", "n", "h", (place <= F.col("k")).alias("in_sketch"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs ``doc_id, item_id, n_shared, n_item, containment`` with containment of the item in the document at least
    ``threshold``."""
    shingles = materialize(item_shingles(items, threshold))
    shape = shingles.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()
    small = shape["n"] <= MAX_BROADCAST_ROWS
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("doc_key"), F.col(text_col).alias("text"))

    def meet(rows: DataFrame, side: DataFrame) -> DataFrame:
        words = rows.select("doc_id", "doc_key", lower_words(F.col("text")).alias("words"))

        def of_width(w: int) -> DataFrame:
            grams = words.select("doc_id", "doc_key", gram_hashes(F.col("words"), w).alias("g"), F.size("words").alias("n_words"))
            # the outer form, as Spark derives a filter from the other that splits the text once for each word
            grams = grams.select("doc_id", "doc_key", F.explode_outer(F.slice("g", F.lit(1), F.greatest(F.col("n_words") - (w - 1), F.lit(0)))).alias("h"))
            part = side.where(F.col("width") == w)
            return grams.join(F.broadcast(part) if small else part, "h")

        return reduce(DataFrame.unionByName, [of_width(w) for w in sorted(shape["widths"])])

    if not shape["widths"]:
        nothing = docs.select(F.col(id_col).alias("doc_id")).where("false")
        return nothing.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_item"), F.lit(0.0).alias("containment"))
    pair = ["doc_id", "doc_key", "item_id", "item_key"]
    candidates = materialize(meet(named, shingles.where("in_sketch")).select(*pair).distinct())
    few = candidates.count() <= MAX_BROADCAST_ROWS
    held = lambda rows: F.broadcast(rows) if few else rows
    # only items and texts of candidates are looked at again
    wanted = shingles.join(held(candidates.select("item_id", "item_key").distinct()), ["item_id", "item_key"], "left_semi")
    texts = named.join(held(candidates.select("doc_id", "doc_key").distinct()), ["doc_id", "doc_key"], "left_semi").dropDuplicates(["doc_id", "doc_key"])
    shared = meet(texts, wanted).join(held(candidates), pair, "left_semi").groupBy(*pair, "h").agg(F.max("n").alias("n"))
    shared = shared.groupBy(*pair).agg(F.count("*").alias("n_shared"), F.max("n").cast("long").alias("n_item"))
    verified = shared.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


def op6_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items)
