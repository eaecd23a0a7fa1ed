"""License scans by diagonal voting.

Every window of three words of a document is looked up among the windows of the templates; each meeting votes for
the diagonal ``place in document - place in template``. A phrase stands where its diagonal has all its votes. For
longer notices, diagonals that lie near each other (words were inserted or dropped) are merged into one span. A span is
then verified: it counts when its windows cover enough of the template's words, each counted once, and when it has the
words that tell its family's licenses apart just as the template has them. Templates are opening sentences and whole texts. Of those in
one place the one with most words of the document on its diagonals remains, so that a whole text counts before its opening, and a license
with a clause more before the one without it, where the clause stands.

A template has three words or more; a shorter one has no window and is never found. Notices of one text that overlap are one place, where
ties go to the first in the list.

Only DataFrame functions are used. Nulls and empty texts have no words and no hits; repeated rows each get their row;
more columns in the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import full_gram_hashes, gram_hashes, lower_words
from .license_texts import TEXTS

K = 3
#: The phrases that give base labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Short standard notices in public use; the labels of the method.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
#: Words that tell the licenses of a family apart, by the start of their labels; words of one meaning have one name.
MARKS = {
    "cc-": {"sharealike": "sa", "alike": "sa", "sa": "sa", "noncommercial": "nc", "commercial": "nc", "nc": "nc", "noderivatives": "nd", "noderivs": "nd", "derivatives": "nd", "nd": "nd"},
    "gpl": {"lesser": "lesser", "affero": "affero"},
    "lgpl": {"lesser": "lesser", "affero": "affero"},
    "agpl": {"lesser": "lesser", "affero": "affero"},
}
#: A notice counts from this share of its words on.
COVERAGE = 0.7
#: Diagonals of one template at most this far apart, or this share of its windows, are one span, and so are votes at most so many words apart.
DRIFT, DRIFT_SHARE, GAP = 4, 0.1, 40
#: Sentinel window that stands for the document itself, so that documents without a hit keep their row.
_SELF = "\x00self"


def templates(spark: SparkSession, phrases=PHRASES, notices=(*NOTICES, *TEXTS)) -> DataFrame:
    """Windows of all templates: label, base, t (template), n_grams, tpos, h, gram."""
    rows = [F.struct(F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text"), F.lit(t).alias("t")) for t, (label, text, base) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in notices])]
    lists = spark.range(1).select(F.explode_outer(F.array(*rows)).alias("r")).select("r.*").withColumn("words", lower_words(F.col("text")))
    grams = lists.select("label", "base", "t", "words", full_gram_hashes(F.col("words"), K).alias("g"))
    grams = grams.select("label", "base", "t", "words", F.size("g").alias("n_grams"), F.posexplode_outer("g").alias("tpos", "h"))
    grams = grams.select("label", "base", "t", "n_grams", "tpos", "h", F.slice("words", F.col("tpos") + 1, F.lit(K)).alias("gram"))
    own = spark.range(1).select(F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(-1).alias("t"), F.lit(0).alias("n_grams"), F.lit(0).alias("tpos"), F.xxhash64(F.lit(_SELF)).alias("h"), F.array().cast("array<string>").alias("gram"))
    return grams.unionByName(own)


def votes(docs: DataFrame, id_col: str, text_col: str, windows: DataFrame) -> DataFrame:
    """One row for each meeting of a document's window and a template's: id, n_words, key, template columns, pos.

    The template windows are a library constant of some 2000 rows, so they are broadcast."""
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), lower_words(F.col(text_col)).alias("words"))
    hashed = words.select("id", "key", "words", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.xxhash64(F.lit(_SELF))), gram_hashes(F.col("words"), K)).alias("g"))
    places = hashed.select("id", "key", "words", "n_words", F.posexplode_outer("g").alias("at", "h"))
    same: Column = F.when(F.col("at") == 0, F.size("gram") == 0).otherwise(F.slice("words", F.greatest(F.col("at"), F.lit(1)), F.lit(K)) == F.col("gram"))
    known = sorted({w for family in MARKS.values() for w in family})
    first = F.greatest(F.col("at") - GAP, F.lit(1))
    around = F.transform(F.slice("words", first, F.lit(2 * GAP + K)), lambda w, i: F.struct((first - 1 + i).alias("at"), w.alias("word")))
    marks = F.when(F.col("t") >= 0, F.filter(around, lambda x: x["word"].isin(known))).otherwise(F.array().cast("array<struct<at:int,word:string>>"))
    return places.join(F.broadcast(windows), (places.h == windows.h) & same).select("id", "key", "n_words", "label", "base", "t", "n_grams", "tpos", (F.col("at") - 1).alias("pos"), marks.alias("marks"))


def _name_in(family: dict[str, str]):
    names = F.create_map(*[F.lit(x) for pair in family.items() for x in pair])
    return lambda w: names[w]


def _told_apart() -> Column:
    """Whether the words that tell the family's licenses apart are the template's, no more and no less.

    Reads t and found, the words of ``MARKS`` in the place that the template would take."""
    fits = F.lit(True)
    for t, (label, text) in enumerate([*NOTICES, *TEXTS], len(PHRASES)):
        family = next((words for start, words in MARKS.items() if label.startswith(start)), None)
        if family:
            own = sorted({family[w] for w in re.findall(r"\w+", text.lower()) if w in family})
            found = F.array_distinct(F.filter(F.transform("found", _name_in(family)), lambda w: w.isNotNull()))
            fits = F.when(F.col("t") == t, F.array_sort(found) == F.array(*map(F.lit, own)).cast("array<string>")).otherwise(fits)
    return fits


def _best_of_place(spans: Column) -> Column:
    """Spans, those that cover most first, without those that lie by more than half in, or around, a better one of another template."""
    both = lambda s, k: F.least(s["end"], k["end"]) - F.greatest(s["start"], k["start"])
    hides = lambda s, k: (k["t"] != s["t"]) & (2 * both(s, k) > F.least(s["end"] - s["start"], k["end"] - k["start"]))
    kept = lambda acc, s: F.when(F.exists(acc, lambda k: hides(s, k)), acc).otherwise(F.array_append(acc, s))
    return F.aggregate(spans, F.slice(spans, 1, 0), kept)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of license phrases and notices.

    Returns one row per input row: ``doc_id, n_words, spans`` with ``spans`` an array of
    ``struct(start, end, label, base, coverage)`` in words, end exclusive, sorted."""
    hits = votes(docs, id_col, text_col, templates(docs.sparkSession))
    # repeated rows vote alike: a diagonal's votes are counted once for each place
    own = ["id", "key", "label", "base", "t", "n_grams"]
    times = F.count(F.when(F.col("t") == -1, 1)).alias("times")
    diagonals = hits.groupBy(*own, (F.col("pos") - F.col("tpos")).alias("diag"), "tpos").agg(F.max("n_words").alias("n_words"), times, F.first("marks").alias("marks"))
    diagonals = diagonals.groupBy(*own, "diag").agg(F.max("n_words").alias("n_words"), F.max("times").alias("times"), F.collect_list("tpos").alias("places"), F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"), F.min("tpos").alias("first"), F.max("tpos").alias("last"))
    # a phrase is complete on its own diagonal; the diagonals of a notice are merged in bands of near ones, then along the document,
    # so that a far diagonal (a window that the template repeats) between two near ones does not part them
    own_run = F.col("base") | (F.col("t") == -1)
    seen = F.transform("places", lambda p: p + F.col("diag"))
    spans = diagonals.withColumns({"seen": seen, "start": F.col("diag") + F.col("first"), "end": F.col("diag") + F.col("last") + K})
    across = Window.partitionBy("id", "key", "t").orderBy("diag")
    far = own_run | (F.col("diag") - F.lag("diag").over(across) > F.greatest(F.lit(DRIFT), DRIFT_SHARE * F.col("n_grams")))
    spans = spans.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("band", F.sum("far").over(across))
    along = Window.partitionBy("id", "key", "t", "band").orderBy("start", "diag")
    apart = F.col("start") - F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)) > GAP
    spans = spans.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(along))
    merged = spans.groupBy(*own, "band", "run").agg(
        F.max("n_words").alias("n_words"), F.max("times").alias("times"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"),
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("diag").alias("least"), F.max("diag").alias("most"), F.min("start").alias("start"), F.max("end").alias("end"),
    )
    # verify: distinct words of the template, and the words that tell it from its family
    words = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + (K - 1))))))
    merged = merged.withColumns({"covered": words("places"), "seen": words("seen")}).withColumn("found", F.transform(F.filter("marks", lambda m: (m["at"] >= F.least("start", "least")) & (m["at"] < F.greatest(F.col("end"), F.col("most") + F.col("n_grams") + (K - 1)))), lambda m: m["word"]))
    merged = merged.withColumn("coverage", F.least(F.lit(1.0), F.when(F.col("base"), F.size("places") / F.greatest("n_grams", F.lit(1))).otherwise(F.col("covered") / (F.col("n_grams") + (K - 1)))))
    wanted = F.when(F.col("base"), F.col("coverage") >= 1).otherwise((F.col("coverage") >= COVERAGE) & _told_apart()) & (F.col("t") >= 0)
    merged = merged.withColumn("wanted", wanted)
    # notices that overlap are one place
    notice = F.col("wanted") & ~F.col("base")
    along = Window.partitionBy("id", "key", notice).orderBy("start", "end", "t")
    merged = merged.withColumn("new", F.when(F.col("start") < F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    merged = merged.withColumn("place", F.when(notice, F.sum("new").over(along)).otherwise(0))
    span = F.struct((-F.col("seen")).alias("fewer"), (-F.col("coverage")).alias("worse"), "t", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "base", "coverage")
    places = merged.groupBy("id", "key", "place").agg(F.max("n_words").alias("n_words"), F.max("times").alias("times"), F.array_sort(F.collect_list(F.when(F.col("wanted"), span))).alias("here"))
    places = places.withColumn("here", F.when((F.col("place") > 0) & (F.size("here") > 1), _best_of_place(F.col("here"))).otherwise(F.col("here")))
    plain = F.transform(F.flatten(F.collect_list("here")), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "label", "base", "coverage")]))
    found = places.groupBy("id", "key").agg(F.max("n_words").alias("n_words"), F.max("times").alias("times"), F.array_sort(plain).alias("spans"))
    return found.select(F.col("id").alias(id_col), "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy")).drop("_copy")


def op1_license_scan(docs: DataFrame) -> DataFrame:
    found = scan_licenses(docs)
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
