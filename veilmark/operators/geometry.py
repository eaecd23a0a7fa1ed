"""Boxes of values among recognised words, and redaction geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import once

BOX = "struct<x:double,y:double,width:double,height:double>"


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def default_box() -> Column:
    return box(F.lit(0), F.lit(0), F.lit(1), F.lit(1))


def layout_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of plain texts on a page of ten columns: id, pos, text, confidence, bbox."""
    from ..functions.scalars import words

    rows = docs.select(id_col, F.posexplode_outer(words(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "text")).where("text is not null")
    return rows.withColumns({"confidence": F.lit(1.0), "bbox": box((F.col("pos") % 10) * 80, F.floor(F.col("pos") / 10) * 20, F.length("text") * 8, F.lit(16))})


#: Characters of words, as the matches between values and recognised words see them.
_WORD = r"[\p{L}\p{N}_]+"
_GAP = r"[^\p{L}\p{N}_]+"
#: Methods whose values are matched with words by parts; others by equal words.
BY_PARTS = ("regex_fuzzy", "ner")


def value_parts(value: Column) -> Column:
    """Words of two characters or more of a value, or the stripped value if it has none."""
    parts = F.filter(F.regexp_extract_all(F.lower(value), F.lit(_WORD), F.lit(0)), lambda p: F.length(p) >= 2)
    return once(parts, lambda own: F.when(F.size(own) > 0, own).otherwise(F.array(F.trim(F.lower(value)))))


def layout(tokens: Column) -> Column:
    """The words of a plain text on a page of ten columns, as an array (pos, text, confidence, bbox)."""
    place = lambda i, n: box((i % 10) * 80, F.floor(i / 10) * 20, n * 8, F.lit(16))
    return F.transform(tokens, lambda w, i: F.struct(i.alias("pos"), w.alias("text"), F.lit(1.0).alias("confidence"), place(i, F.length(w)).alias("bbox")))


def match_words(page: Column) -> Column:
    """The words of a ``layout`` as values are matched with them: lower case, without marks; words of marks alone are left out."""
    plain = F.transform(page, lambda w: F.struct(w["pos"].alias("pos"), F.regexp_replace(F.lower(w["text"]), _GAP, "").alias("word"), w["bbox"].alias("bbox")))
    return F.filter(plain, lambda w: w["word"] != "")


def value_box(page_words: Column, field: Column, by_parts: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Box of a field (value, method, field_name and, for approximate matches, word_start and word_count) among ``match_words``.

    The box is the union of the boxes of the words that belong to the value: with ``by_parts`` those that contain a part of it or are
    contained in one, else those that equal one of its words; an approximate match has the words of its window. A value whose
    words stand nowhere gets the unit box, a signature its region of the page."""
    parts = F.when(by_parts, value_parts(field["value"])).otherwise(F.regexp_extract_all(F.lower(field["value"]), F.lit(_WORD), F.lit(0)))
    near = lambda w, parts: F.when(by_parts, F.exists(parts, lambda p: F.contains(p, w) | F.contains(w, p))).otherwise(F.array_contains(parts, w))
    window = lambda w: (w["pos"] >= field["word_start"]) & (w["pos"] < field["word_start"] + field["word_count"])
    hits = once(parts, lambda parts: F.filter(page_words, lambda w: F.when(field["word_start"].isNotNull(), window(w)).otherwise(near(w["word"], parts))))

    def union(hit: Column) -> Column:
        edge = lambda pick, c, size=None: pick(F.transform(hit, lambda w: w["bbox"][c] + (w["bbox"][size] if size else 0)))
        corner = F.struct(edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x", "width").alias("x1"), edge(F.array_max, "y", "height").alias("y1"))
        return F.when((F.size(hit) > 0) & (field["method"] != "image"), once(corner, lambda c: box(c["x0"], c["y0"], c["x1"] - c["x0"], c["y1"] - c["y0"]))).otherwise(default_box())

    found = once(hits, union)
    if width is not None and height is not None:
        found = F.when((field["method"] == "image") & (field["field_name"] == "signature"), signature_box(width, height)).otherwise(found)
    return found


def boxed(fields: Column, page: Column, typed: Column, names: tuple[str, ...], width: Column | None = None, height: Column | None = None) -> Column:
    """``fields`` (with the columns ``names``) with ``bbox``; values of typed documents that a pattern or a name rule found are matched with words by parts."""

    def add(f: Column, words: Column) -> Column:
        b = value_box(words, f, typed & f["method"].isin(*BY_PARTS), width, height)
        return F.struct(*[f[c].alias(c) for c in names], b.alias("bbox"))

    return once(match_words(page), lambda words: F.transform(fields, lambda f: add(f, words)))


def normalise(b: Column, width: Column, height: Column) -> Column:
    """Percent of the page to two digits; unchanged without a page."""
    scaled = box(F.round(b["x"] / width * 100, 2), F.round(b["y"] / height * 100, 2), F.round(b["width"] / width * 100, 2), F.round(b["height"] / height * 100, 2))
    return F.when((width <= 0) | (height <= 0), b).otherwise(scaled)


def pad_clamp(b: Column, width: Column, height: Column, pad: int = 4) -> Column:
    """Corners (x0, y0, x1, y1) of the padded box within the page; the box is cut to whole pixels first."""
    whole = lambda c: b[c].cast("int")
    return F.struct(
        F.greatest(whole("x") - pad, F.lit(0)).cast("double").alias("x0"), F.greatest(whole("y") - pad, F.lit(0)).cast("double").alias("y0"),
        F.least(whole("x") + whole("width") + pad, width).cast("double").alias("x1"), F.least(whole("y") + whole("height") + pad, height).cast("double").alias("y1"),
    )


def painted(corners: Column, decision: Column, keep: int = 40) -> Column:
    """What a decision paints: all of the padded box, all but its first pixels for a mask, nothing when allowed."""
    from_x = F.when(decision == "mask", F.least(corners["x0"] + keep, corners["x1"])).otherwise(corners["x0"])
    return F.when(decision != "allow", F.struct(from_x.alias("x0"), corners["y0"].alias("y0"), corners["x1"].alias("x1"), corners["y1"].alias("y1")))


def signature_box(width: Column, height: Column) -> Column:
    """Where a page has its signature, in whole pixels."""
    return box(*[F.floor(x) for x in (width * 0.05, height * 0.75, width * 0.4, height * 0.2)])


def drawable(b: Column) -> Column:
    return (b["width"] > 0) & (b["height"] > 0)
