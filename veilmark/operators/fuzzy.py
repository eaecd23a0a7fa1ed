"""Approximate matches: word windows compared with the literal form of a pattern by the Indel ratio.

Windows have at most five words. The ratio is 200 times the longest common subsequence over the sum of lengths. Both are folds over
arrays within Spark: of a text's words only windows that have enough of the template's characters, by sums over their words, are put together and
compared at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import once, words

MAX_WORDS = 5
#: Characters of a template whose places fit the bits of one number; longer ones take a fold over rows of the table.
BITS = 62
#: Starts of windows that are listed together; a multiple of eight, since Parquet packs numbers by eight.
BLOCK = 16
MATCH = "struct<value:string,confidence:double,word_start:int,word_count:int>"


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings."""

    def by_bits(x: Column, y: Column) -> Column:
        # bit i of a character's number: it stands at place i of x; a zero in the row: a place that a subsequence uses
        bits = lambda c: F.aggregate(F.transform(x, lambda d, i: F.when(d == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v)
        places = F.map_from_entries(F.transform(F.array_distinct(x), lambda c: F.struct(c, bits(c))))
        full = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(x)) - 1

        def step(row: Column, hit: Column) -> Column:
            return (row + hit).bitwiseOR(row - hit)

        def fold(s: Column) -> Column:
            start = s["full"]
            add = lambda row, c: once(row.bitwiseAND(F.coalesce(F.try_element_at(s["places"], c), F.lit(0).cast("long"))), lambda hit: step(row, hit).bitwiseAND(s["full"]))
            return F.size(x) - F.bit_count(F.aggregate(y, start, add)).cast("int")

        return once(F.struct(places.alias("places"), full.alias("full")), fold)

    def by_rows(x: Column, y: Column) -> Column:
        zero = F.array_repeat(F.lit(0), F.size(x) + 1)
        cell = lambda out, row, j, c: F.when(F.get(x, j) == c, F.get(row, j) + 1).otherwise(F.greatest(F.get(row, j + 1), F.element_at(out, -1)))
        line = lambda row, c: F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.array(F.lit(0)), lambda out, j: F.array_append(out, cell(out, row, j, c)))
        return F.element_at(F.aggregate(y, zero, line), -1)

    def compared(p: Column) -> Column:
        length = F.when(F.size(p["x"]) <= BITS, by_bits(p["x"], p["y"])).otherwise(by_rows(p["x"], p["y"]))
        return F.when((F.size(p["x"]) > 0) & (F.size(p["y"]) > 0), length).otherwise(F.lit(0))

    # the template, which is the shorter one mostly, gives the places
    return once(F.struct(_chars(b).alias("x"), _chars(a).alias("y")), compared)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (length of a + length of b); two empty strings are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / F.greatest(total, F.lit(1)))


def best_window(tokens: Column, template: Column, threshold: Column) -> Column:
    """Struct (value, confidence, word_start, word_count) of the window with the best ratio strictly above ``threshold``, the first of equals by
    number of words, then place; null without one. ``tokens`` are a text's words."""
    bits = "struct<length:int,hits:int>"

    def sized(w: Column) -> Column:
        # a word's characters, and those of them that the template has
        return F.transform(w, lambda x: F.struct(F.length(x).alias("length"), (F.length(x) - F.length(F.call_function("translate", x, template, F.lit("")))).alias("hits")).cast(bits))

    def windows(p: Column, n: int) -> Column:
        total = lambda i, c: sum((F.get(p["sizes"], i + k)[c] for k in range(1, n)), F.get(p["sizes"], i)[c])
        starts = F.when(F.size(p["words"]) >= n, F.sequence(F.lit(0), F.greatest(F.size(p["words"]) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        fits = lambda i: F.lit(200.0) * F.least(total(i, "hits"), F.length(template)) > threshold * (total(i, "length") + F.length(template))
        return F.transform(F.filter(starts, fits), lambda i: F.struct(F.lit(n).alias("n"), i.alias("i")))

    def scored(p: Column) -> Column:
        joined = lambda x: F.array_join(F.slice(p["words"], x["i"] + 1, x["n"]), "")
        found = F.transform(F.concat(*[windows(p, n) for n in range(1, MAX_WORDS + 1)]), lambda x: F.struct(indel_ratio(joined(x), template).alias("score"), (-x["n"]).alias("n"), (-x["i"]).alias("i")))
        return once(F.array_max(F.filter(found, lambda x: x["score"] > threshold)), lambda x: F.when(x.isNotNull(), F.struct(
            F.array_join(F.slice(p["words"], -x["i"] + 1, -x["n"]), " ").alias("value"), (x["score"] / 100).alias("confidence"), (-x["i"]).alias("word_start"), (-x["n"]).alias("word_count"),
        ).cast(MATCH)))

    return F.when(F.length(template) > 0, once(F.struct(tokens.alias("words"), sized(tokens).alias("sizes")), scored))


def window_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All windows: id, n, start, candidate.

    They are many times the text, so their order counts where they are written: by blocks of starts, within a block the longest windows first and
    the last start first. A window is then mostly a stretch of one shortly before it, and starts recur in step, so that Parquet's pages
    compress. No more than a block's windows are held at once."""
    windows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n in range(MAX_WORDS, 0, -1) for i in range(BLOCK - 1, -1, -1)])
    rows = docs.select(id_col, words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    rows = rows.select(id_col, "w", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK))).alias("first"))
    rows = rows.select(id_col, "first", F.slice("w", F.col("first") + 1, BLOCK + MAX_WORDS - 1).alias("w"))
    rows = rows.select(id_col, "first", "w", F.inline(windows)).where(F.col("i") + F.col("n") <= F.size("w"))
    return rows.select(id_col, "n", (F.col("first") + F.col("i")).alias("start"), F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("candidate"))
