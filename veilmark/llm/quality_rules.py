"""Quality rules with adaptive thresholds.

Text statistics are computed row by row. Per language and source, mergeable KLL quantile sketches of them give an upper fence instead of
a fixed cutoff: the third quartile and some standard errors beyond it. The error has two parts. One is the group's own spread, read
from its sketch as the larger of the interquartile range and the distance from the median to the ninth decile, each in units of a standard deviation;
the latter tells the spread of statistics that are zero for most texts, and bears up to a tenth of junk. The other is what chance does
to a share of a text's own length, so that one repeated line fails no short text and a long one is held to its group more closely. A group's
quantiles are drawn towards those of its language, merged from its groups, and these towards those of all: with ``n`` rows the group counts
``n / (n + PRIOR)``, at every size. The fences are joined back and filter.

Only DataFrame functions are used. Null texts have no words; null languages and sources, or missing columns, are groups of their own;
repeated rows each get their row; columns of the input with names of the statistics are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_GAP, materialize, split_words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rows that the quartiles of the language count for in those of a group, and those of all in those of a language.
PRIOR = 200
#: Standard errors from the third quartile to the fence.
ERRORS = 4.0
#: Statistic: its count, the column of which it is a share, and units that a single event marks (a repeated window of three words marks six).
METRICS = {
    "symbol_ratio": ("n_symbols", "n_words", 1), "dup_line_ratio": ("n_dup_lines", "n_lines", 1), "repeat_ratio": ("n_repeat_words", "n_words", 6),
    "upper_ratio": ("n_upper", "word_chars", 1), "bang_ratio": ("n_bang", "n_words", 1),
}
#: Quantiles that are read, and how many standard deviations a normal variable has from the first to the third and from the second to the last.
QUANTILES = {"low": 0.25, "mid": 0.5, "high": 0.75, "top": 0.9}
NORMAL_QUARTILES, NORMAL_DECILE = 1.349, 1.2816
SKETCH_K = 200


def repeated_words(words: Column, grams: Column) -> Column:
    """Words that lie in a three-word window found at least twice; ``grams`` are the hashes of all windows."""
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), placed)


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_bang."""
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*others, text.alias("_t"), split_words(text, SPACE_GAP).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(*others, "_t", "_w", F.array_join("_w", "").alias("_j"), lines.alias("_l"), F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))).alias("_a"))
    rows = rows.withColumn("_g", F.slice("_a", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))))
    rows = rows.withColumn("_s", repeated_words(F.col("_w"), F.col("_g")))
    same = lambda a, b: F.get("_s", a)["g"] == F.get("_s", b)["g"]
    again = F.filter("_s", lambda x, j: F.coalesce(x["g"] == F.get("_s", j - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("_s", j + 1)["g"], F.lit(False)))
    places = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    left = lambda keep: F.length(F.regexp_replace("_j", f"[^{keep}]+", "")).cast("long")
    return rows.select(
        *others, F.size("_w").cast("long").alias("n_words"), F.length("_j").cast("long").alias("word_chars"), left("#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size("_l").cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("_s").isNotNull(), F.size(F.array_distinct(places))), F.lit(0)).cast("long").alias("n_repeat_words"),
        left("A-Z").alias("n_upper"), left("!").alias("n_bang"),
    )


def _units(metric: str) -> Column:
    return F.greatest(METRICS[metric][1], F.lit(1))


def _ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumns({m: F.col(count) / _units(m) for m, (count, _, _) in METRICS.items()})


def _quantiles(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """keys, n and the quantiles of each metric from its sketch."""
    q = lambda m, at: F.kll_sketch_get_quantile_double(F.col(m), F.lit(at))
    return rows.select(*keys, F.col("n").alias(f"{tag}_n"), *[q(m, at).alias(f"{tag}_{m}_{k}") for m in METRICS for k, at in QUANTILES.items()])


def group_fences(rows: DataFrame) -> DataFrame:
    """_lang, _source, and for each metric the third quartile (base) and the spread of the group, drawn towards larger groups."""
    sketches = [F.kll_sketch_agg_double(F.col(m), F.lit(SKETCH_K)).alias(m) for m in METRICS]
    per_source = materialize(rows.groupBy("_lang", "_source").agg(F.count("*").alias("n"), *sketches))
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(F.col(m), F.lit(SKETCH_K)).alias(m) for m in METRICS]]
    by_source, by_lang = _quantiles(per_source, ["_lang", "_source"], "s"), _quantiles(per_source.groupBy("_lang").agg(*merged), ["_lang"], "l")
    # the groups' quantiles are one small row for each language and source; they are put together before they meet the rows
    groups = by_source.join(by_lang, "_lang").join(F.broadcast(_quantiles(per_source.agg(*merged), [], "w")))
    share = lambda tag: F.col(f"{tag}_n") / (F.col(f"{tag}_n") + PRIOR)
    drawn = lambda tag, own, other: share(tag) * F.col(own) + (1 - share(tag)) * other
    at = lambda m, k: drawn("s", f"s_{m}_{k}", drawn("l", f"l_{m}_{k}", F.col(f"w_{m}_{k}")))
    spread = lambda m: F.greatest((at(m, "high") - at(m, "low")) / NORMAL_QUARTILES, (at(m, "top") - at(m, "mid")) / NORMAL_DECILE)
    return groups.select("_lang", "_source", *[c for m in METRICS for c in (at(m, "high").alias(f"base_{m}"), spread(m).alias(f"spread_{m}"))])


def adaptive_verdicts(stats: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``stats`` with the metrics, the fence of each (``fence_`` and its name) and ``within`` (no metric above its fence)."""
    rows = _ratios(stats)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c in stats.columns else F.lit("\x00")
    rows = rows.withColumns({"_lang": key(lang_col), "_source": key(source_col)})
    joined = rows.join(group_fences(rows), ["_lang", "_source"])

    def fence(m: str) -> Column:
        event = METRICS[m][2] / _units(m)
        chance = F.col(f"base_{m}") * event + event * event
        return F.col(f"base_{m}") + ERRORS * F.sqrt(F.col(f"spread_{m}") * F.col(f"spread_{m}") + chance)

    judged = joined.withColumns({f"fence_{m}": fence(m) for m in METRICS})
    verdict = reduce(Column.__and__, [F.col(m) <= F.col(f"fence_{m}") for m in METRICS])
    return judged.withColumn("within", verdict).drop("_lang", "_source", *[f"{x}_{m}" for x in ("base", "spread") for m in METRICS])


def filter_quality(docs: DataFrame) -> DataFrame:
    """One row per document: its statistics, ``base_failed`` and ``kept``."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    stats = materialize(text_stats(docs.select(*keep, "text")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return adaptive_verdicts(stats).withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("within"))


def op4_quality_rules(docs: DataFrame) -> DataFrame:
    return filter_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
