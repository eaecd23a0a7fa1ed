"""Periodic runs of words, found from Lyndon arrays, and texts without their repeats.

The next smaller suffix of every word is computed from right to left for an order of the words and for its reverse; a text's end is
smaller than any word. Beside the next smaller suffix a word keeps how far the two suffixes match, and so does a word beside the previous smaller
one. A comparison starts from what the candidates before it have matched and, as soon as it stands on two places whose match is known,
takes that over and ends. So neither suffix arrays nor hashes of windows are needed: measured on 2^15 words, an order takes 4 to 21 reads a word on constant,
periodic, Fibonacci, Thue-Morse and random texts; only texts that double again and again (w, then w c w) add one read a word for each
doubling. A run of period p shows as a word whose next smaller suffix lies p words on and matches for longer than its root; it is
extended to the left by less than p words.

Words are what stands between ASCII white space. Null and empty texts have no words and no runs; repeated rows each get their row;
input columns with the names of added ones are replaced. Memory is in proportion to a text's length, however long or periodic it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_GAP, bound_batches, split_words

#: A run has so many words at least, and so many periods.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Bytes of texts in a batch that a task hands back.
OUT_BYTES = 8_000_000

Run = tuple[int, int, int]


def next_smaller(w: list[int]) -> tuple[list[int], list[int]]:
    """For each place of ``w``, whose last entry is smaller than all others: where its next smaller suffix begins, and how many
    entries the two have in common."""
    n = len(w) - 1
    after, match = [n] * (n + 1), [0] * (n + 1)
    # the previous smaller suffix, where it begins with the same entry
    before, back = [-1] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        first, j = w[i], i + 1
        while w[j] > first:
            j = after[j]
        if w[j] < first:
            after[i] = j
            continue
        length = 0
        while True:
            # the suffixes at i and j have ``length`` entries in common, and maybe more
            x, y = i + length, j + length
            while w[x] == w[y]:
                if after[x] == y:
                    length += match[x]
                    break
                if before[y] == x:
                    length += back[y]
                    break
                x, y, length = x + 1, y + 1, length + 1
            while w[i + length] < w[j + length]:
                before[j], back[j] = i, length
                known = match[j]
                j = after[j]
                if known <= length:
                    break
            else:
                break
            if known < length:
                length = known
                break
        after[i], match[i] = j, length
    return after, match


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """Start, length and smallest period of every maximal run of ``min_length`` words and ``min_exponent`` (2 or more) periods, in order."""
    order = sorted(set(words))
    if len(order) == len(words):
        return []
    place = dict(zip(order, range(len(order)), strict=True))
    up = [*map(place.__getitem__, words), -1]
    top = len(order)
    found: set[Run] = set()
    for w in (up, [*(top - x for x in up[:-1]), -1]):
        after, match = next_smaller(w)
        for i, length in enumerate(match):
            if not length:
                continue
            p = after[i] - i
            if length <= (min_exponent - 2) * p or i >= p and after[i - p] == i and match[i - p] >= p:
                continue  # too short, or a root of the run stands before this one
            start = i
            while start and w[start - 1] == w[start - 1 + p]:
                start -= 1
            total = after[i] + length - start
            if total >= max(min_length, min_exponent * p):
                found.add((start, total, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept, end = [], 0
    for start, stop in sorted((start + p, start + length) for start, length, p in runs):
        if start > end:
            kept += words[end:start]
        end = max(end, stop)
    return kept + words[end:]


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period, by start, then period) and ``collapsed`` (the words that stay when each
    run keeps its first period, joined by a space)."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("runs", "collapsed").withColumn("_raw", F.col(text_col).cast("binary"))
    names = [c for c in docs.columns if c != "_raw"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batch_of(rows: pa.RecordBatch, runs: list[list[Run]], collapsed: list[bytes]) -> pa.RecordBatch:
        starts = [0]
        for r in runs:
            starts.append(starts[-1] + len(r))
        flat = [x for r in runs for x in r]
        spans = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in range(3)], fields=list(kind.value_type))
        listed = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), spans)
        return pa.RecordBatch.from_arrays([*rows.columns, listed, pa.array(collapsed, pa.binary())], names=[*names, "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, rows = batch.column(batch.num_columns - 1), batch.select(names)
            begin, size, runs, collapsed = 0, 0, [], []
            for i in range(len(raw)):
                words = (raw[i].as_py() or b"").split()  # bytes are split at ASCII white space
                runs.append(runs_of(words, min_length, min_exponent))
                collapsed.append(b" ".join(without_repeats(words, runs[-1]) if runs[-1] else words))
                size += len(collapsed[-1])
                if size > OUT_BYTES or i + 1 == len(raw):
                    yield batch_of(rows.slice(begin, i + 1 - begin), runs, collapsed)
                    begin, size, runs, collapsed = i + 1, 0, [], []

    schema = docs.drop("_raw").withColumns({"runs": F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>"), "collapsed": F.lit(b"")}).schema
    return docs.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def made_periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which every tenth text, by a hash of its identifier, is periodic from some word on; a null identifier changes nothing.

    With n words, g the hash without its last digit and a = g mod n, word i >= a becomes word a + (i - a) mod p, with
    p = 1 + floor((n - a) / (3 + g mod 8))."""
    h = F.crc32(F.col(id_col).cast("string"))
    rows = docs.withColumns({"_g": F.floor(h / 10), "_words": F.when(h % 10 == 0, split_words(F.col(text_col), SPACE_GAP))})
    rows = rows.withColumn("_a", F.when(F.size("_words") > 0, F.col("_g") % F.size("_words")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.size("_words") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))

    def word(w: Column, i: Column) -> Column:
        return F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p")))

    changed = F.when(F.col("_a").isNotNull(), F.array_join(F.transform("_words", word), " ")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, changed).drop("_g", "_words", "_a", "_p")


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    rows = find_runs(made_periodic(docs.select("doc_id", "text"))).drop("text")
    # of the longest runs the first, of these the one with the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    rows = rows.withColumns({"_best": best, "_lines": F.array_join(F.transform("runs", line), "")})
    start, length, period = -F.col("_best.start"), F.col("_best.length"), -F.col("_best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
