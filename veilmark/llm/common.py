"""Shared helpers: table access, scratch tables in the shared folder, word columns and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Everything but digits, a-z and characters beyond ASCII separates words (after lower-casing A-Z).
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space separates words.
SPACE_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share. Only a session in one process may do without
    that setting: it gets a local temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/veilmark-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later uses neither recompute it nor depend on
    the executor that made it. Within a ``Scratch`` the table lives until that ends."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if Scratch.open:
        Scratch.open[-1].tables.append((back, path))
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Scratch tables of a job, by way of ``with``: they are removed when it ends, but for its result.

    Plans that read them must have run by then; ``result`` writes the last one."""

    open: ClassVar[list[Scratch]] = []

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []
        self.kept: tuple[DataFrame, str] | None = None

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch.open.remove(self)
        for df, _ in list(self.tables):
            if self.kept is None or df is not self.kept[0]:
                self.drop(df)
        if self.kept and Scratch.open:
            Scratch.open[-1].tables.append(self.kept)

    def drop(self, df: DataFrame) -> None:
        """Remove a table of this job that no later step reads."""
        for entry in [x for x in self.tables if x[0] is df]:
            self.tables.remove(entry)
            remove(df.sparkSession, entry[1])

    def result(self, df: DataFrame) -> DataFrame:
        back = materialize(df)
        self.kept = self.tables[-1]
        return back


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let tasks in Python take at most so many rows at once, as they hold whole texts; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def give_back(batches: Iterator) -> Iterator:
    """What a task in Python yields; at its end the worker, which later stages use again, hands the memory that it has freed back to the machine."""
    import ctypes

    import pyarrow as pa

    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, gap: str) -> Column:
    """Words between runs of ``gap``; an empty array for null and for texts without a word."""
    parts = F.split(F.coalesce(text, F.lit("")), gap)
    return F.filter(parts, lambda w: w != "")


def lower_words(text: Column, gap: str = ALNUM_GAP) -> Column:
    return split_words(ascii_lower(text), gap)


def gram_hashes(words: Column, k: int) -> Column:
    """Hashes of the ``k`` words from each place on; places too near the end give shorter grams.

    ``words`` has to be a plain column, as it is read once for each place."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))


def full_gram_hashes(words: Column, k: int) -> Column:
    """Hashes of all windows of ``k`` words; the whole sequence is one window if it is shorter; none for no words."""
    return F.slice(gram_hashes(words, k), F.lit(1), F.greatest(F.size(words) - (k - 1), F.least(F.size(words), F.lit(1))))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph with long node columns ``a`` and ``b``.

    Returns ``node, component`` (the smallest node reachable) for every node that has an edge. Alternates
    large-star and small-star steps; a node's neighbours are only ever reduced to their minimum, never collected.
    Each round is written to the shared folder, so that lineage stays short. The rounds end when the edges no longer change, which
    they do as every edge only ever moves to smaller nodes."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs)
    content = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    old = content(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u moves to u's minimum
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialize(small.unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, old = old, content(new)
        if Scratch.open:
            Scratch.open[-1].drop(pairs)
        pairs = new
        if old == before:
            break
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def joined_components(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` (see ``connected_components``) as further ``edges`` join them.

    A component counts as one node, so that the rounds go through the edges between components only and not through those that have formed them."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = connected_components(between)
    known = comps.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_low")), "component", "left")
    return known.select("node", F.coalesce("_low", "component").alias("component")).unionByName(merged.join(comps.select("node"), "node", "left_anti"))
