"""Recognised pages: stored output of recognition engines as words with boxes, and the chain that asks a costlier engine for the remainder.

A page is a struct: text, words (text, confidence, x, y, width, height, in reading order), avg_confidence and n_words. It stays in its
document's row; nothing here shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import once, strip
from .tables import choose_ocr

#: A first engine's page is good enough with this mean confidence and as many words; so is a second one's with the words.
MIN_CONFIDENCE, MIN_WORDS = 0.72, 5

WORD = "struct<text:string,confidence:double,x:int,y:int,width:int,height:int>"
PAGE = f"struct<text:string,words:array<{WORD}>,avg_confidence:double,n_words:int>"
_WORD_TREE = "struct<symbols:array<struct<text:string>>,confidence:double,bounding_box:struct<vertices:array<struct<x:double,y:double>>>>"
_PAGE_TREE = f"struct<pages:array<struct<blocks:array<struct<paragraphs:array<struct<words:array<{_WORD_TREE}>>>>>>>,text:string>"


def _word(text: Column, confidence: Column, xs: Column, ys: Column) -> Column:
    """A word with the box around its polygon; coordinates are cut to whole pixels."""
    whole = [F.transform(v, lambda p: p.cast("int")) for v in (xs, ys)]
    edges = F.struct(*[edge(v).alias(n) for v, axis in zip(whole, "xy", strict=True) for edge, n in ((F.array_min, axis), (F.array_max, f"{axis}1"))])
    return once(edges, lambda e: F.struct(text.alias("text"), confidence.alias("confidence"), e["x"].alias("x"), e["y"].alias("y"), (e["x1"] - e["x"]).alias("width"), (e["y1"] - e["y"]).alias("height")))


def page(words: Column, text: Column | None = None) -> Column:
    """A page of the words; its text is theirs, or ``text`` where there are none. Null words give null."""

    def whole(w: Column) -> Column:
        n = F.size(w)
        joined = F.array_join(F.transform(w, lambda x: x["text"]), " ")
        total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x["confidence"])
        mean = F.when(n > 0, total / n).otherwise(0.0)
        body = joined if text is None else F.when(n > 0, joined).otherwise(F.coalesce(text, F.lit("")))
        return F.when(w.isNotNull(), F.struct(body.alias("text"), w.alias("words"), mean.alias("avg_confidence"), n.alias("n_words"))).cast(PAGE)

    return once(words, whole)


def _each(points: Column, reads: list[Callable[[Column], Column]]) -> list[Column]:
    return [F.transform(points, read) for read in reads]


def _lines(lines: Column) -> Column:
    """Page of lines of a polygon, a text and a confidence; a line that cannot be read makes the page null, as if the engine had failed."""

    def word(line: Column) -> Column:
        read = lambda points: _word(strip(F.get(line, F.lit(1))), F.get(line, F.lit(2)).try_cast("double"), *_each(points, [lambda p: F.get(p, F.lit(0)), lambda p: F.get(p, F.lit(1))]))
        return once(F.from_json(F.get(line, F.lit(0)), "array<array<double>>"), read)

    unread = lambda w: w["text"].isNull() | ((w["text"] != "") & (w["confidence"].isNull() | w["width"].isNull() | w["height"].isNull()))
    return page(once(F.transform(lines, word), lambda read: F.when(~F.exists(read, unread), F.filter(read, lambda w: w["text"] != ""))))


def page_of_lines(output: Column) -> Column:
    """Page from JSON ``[[polygon, [text, confidence]], ...]``. Null, malformed and empty output give null; blank texts are left out."""

    def flat(line: Column) -> Column:
        return once(F.from_json(F.get(line, F.lit(1)), "array<string>"), lambda pair: F.array(F.get(line, F.lit(0)), F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))

    lines = once(F.from_json(output, "array<array<string>>"), lambda x: F.when(F.size(x) > 0, F.transform(x, flat)))
    return _lines(lines)


def page_of_triples(output: Column) -> Column:
    """Page from JSON ``[[polygon, text, confidence], ...]``. Null and malformed output give null, an empty list a page without words."""
    return _lines(F.from_json(output, "array<array<string>>"))


def page_of_blocks(output: Column) -> Column:
    """Page from JSON of pages, blocks, paragraphs, words and symbols, in that order, with the whole text beside them.

    Missing levels hold nothing, a missing coordinate or confidence is 0; a word without vertices makes the page null."""
    return once(F.from_json(output, _PAGE_TREE), _page_of_tree)


def _page_of_tree(tree: Column) -> Column:
    some = lambda a, kind: F.coalesce(a, F.array().cast(f"array<{kind}>"))
    blocks = F.flatten(F.transform(some(tree["pages"], _of("pages")), lambda p: some(p["blocks"], _of("blocks"))))
    paragraphs = F.flatten(F.transform(blocks, lambda b: some(b["paragraphs"], _of("paragraphs"))))
    words = F.flatten(F.transform(paragraphs, lambda p: some(p["words"], _WORD_TREE)))

    def word(w: Column) -> Column:
        corners = w["bounding_box"]["vertices"]
        at = _each(corners, [lambda v: F.coalesce(v["x"], F.lit(0.0)), lambda v: F.coalesce(v["y"], F.lit(0.0))])
        return _word(F.array_join(F.transform(some(w["symbols"], "struct<text:string>"), lambda s: s["text"]), ""), F.coalesce(w["confidence"], F.lit(0.0)), *at)

    read = F.when(tree.isNotNull(), F.transform(words, word))
    return page(once(read, lambda r: F.when(~F.exists(r, lambda w: w["width"].isNull()), r)), tree["text"])


def _of(level: str) -> str:
    """Type of an element of a level's list."""
    kind = f"struct<words:array<{_WORD_TREE}>>"
    for name in ("paragraphs", "blocks", "pages"):
        if name == level:
            return kind
        kind = f"struct<{name}:array<{kind}>>"
    raise ValueError(level)


def engine(recognise: Callable[[bytes], object]) -> Callable[[Column], Column]:
    """A column function from a Python engine, which takes an image's bytes and returns what JSON can hold, or None.

    It runs in Arrow batches and only for images that are not null; an engine that fails on an image has no result for it."""

    def one(image: bytes | None) -> str | None:
        if image is None:
            return None
        try:
            found = recognise(bytes(image))
        except Exception:  # noqa: BLE001 - whatever an engine raises, the next one has its turn
            return None
        return None if found is None else json.dumps(found)

    def batch(images: pd.Series) -> pd.Series:
        return images.map(one, na_action=None)

    # Not deterministic for the planner, so that no projection repeats the call.
    return F.pandas_udf(batch, StringType()).asNondeterministic()


def recognise(rows: DataFrame, image: str, first: Callable[[Column], Column], second: Callable[[Column], Column], third: Callable[[Column], Column], into: str = "page") -> DataFrame:
    """``rows`` with the page of the first engine that is good enough, and ``<into>_engine`` (1 to 3, null if all failed).

    Engines give lines, blocks and triples. A costlier engine gets null instead of the image where an earlier page is good enough, so
    that it works on the remainder alone while rows stay in their partitions: no split, union or second scan. A null image and a page
    that nobody could read have a page without words. A clashing ``into`` column is replaced."""
    kept = [c for c in rows.columns if c not in (into, f"{into}_engine")]
    enough = lambda p: F.coalesce(F.col(p)["n_words"] >= MIN_WORDS, F.lit(False))
    names = ["_first", "_second", "_third"]
    out = rows.withColumn("_output", first(F.col(image))).withColumn(names[0], page_of_lines(F.col("_output")))
    done = enough(names[0]) & (F.col(names[0])["avg_confidence"] >= MIN_CONFIDENCE)
    out = out.withColumn("_output", second(F.when(~F.coalesce(done, F.lit(False)), F.col(image)))).withColumn(names[1], page_of_blocks(F.col("_output")))
    rest = ~F.coalesce(done, F.lit(False)) & ~enough(names[1])
    out = out.withColumn("_output", third(F.when(rest, F.col(image)))).withColumn(names[2], page_of_triples(F.col("_output")))
    none = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{WORD}>").alias("words"), F.lit(0.0).alias("avg_confidence"), F.lit(0).alias("n_words"))
    marked = [F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.avg_confidence"), F.col(f"{n}.n_words"), F.lit(i).alias("engine"), F.col(n).alias("page"))) for i, n in enumerate(names, 1)]
    chosen = out.select(*kept, *[m.alias(n) for m, n in zip(marked, names, strict=True)]).withColumn("_chosen", choose_ocr(*names))
    return chosen.select(*kept, F.coalesce(F.col("_chosen.page"), none).alias(into), F.col("_chosen.engine").alias(f"{into}_engine"))
