"""Document types from keywords and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import KEYWORDS, MIN_TYPE_SCORE, TYPES

#: Keywords are found by pieces of their text of these lengths, long texts read in blocks of so many characters.
GRAMS, BLOCK = (8, 4, 2, 1), 1 << 16
#: A text's pieces are kept only if they begin like a listed one; so many different beginnings, of so many characters, are broadcast.
HEAD, MAX_HEADS = 4, 200_000


def keyword_scores(text: Column) -> dict[str, Column]:
    """Score of each type: a point a keyword and two a pattern, over all points. The text is scanned in one projection."""
    out = {}
    for kind in TYPES:
        keys, patterns = KEYWORDS[kind]
        points = [F.contains(F.lower(text), F.lit(k)).cast("int") for k in keys] + [text.rlike("(?i)" + p).cast("int") * 2 for p in patterns]
        out[kind] = sum(points[1:], points[0]) / F.lit(len(keys) + 2 * len(patterns))
    return out


def classify(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with document_type and type_confidence; the first type wins ties; null texts are unknown."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("pos"), F.lit(k).alias("type")) for i, (k, s) in enumerate(keyword_scores(text).items())]))
    rows = docs.withColumn("_best", best)
    known = F.col("_best.score") >= MIN_TYPE_SCORE
    return rows.withColumns({"document_type": F.when(known, F.col("_best.type")).otherwise("unknown"), "type_confidence": F.col("_best.score")}).drop("_best")


def keyword_table(spark: SparkSession) -> DataFrame:
    """The default keywords as a table: document_type, type_pos, keyword."""
    return spark.createDataFrame([(t, i, k) for i, t in enumerate(TYPES) for k in KEYWORDS[t][0]], "document_type string, type_pos int, keyword string")


def _grams(text: Column) -> Column:
    """Distinct pieces of all ``GRAMS`` lengths of a text."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in GRAMS]))


def keyword_index(known: DataFrame) -> DataFrame:
    """keyword and gram: each keyword with the piece of it, of the greatest of the ``GRAMS`` lengths that fits, that the fewest keywords have."""
    length = F.lit(GRAMS[-1])
    for n in reversed(GRAMS[:-1]):
        length = F.when(F.length("keyword") >= n, F.lit(n)).otherwise(length)
    own = known.select("keyword").distinct().withColumn("gram", F.explode(F.filter(_grams(F.col("keyword")), lambda g: F.length(g) == length)))
    use = own.groupBy("gram").agg(F.count("*").alias("n"))
    return own.join(use, "gram").groupBy("keyword").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def classify_by(docs: DataFrame, keywords: DataFrame, patterns: dict[str, list[str]] | None = None, text_col: str = "text") -> DataFrame:
    """As ``classify``, with any number of keywords and types as a table (document_type, type_pos, keyword).

    An inverted index from a piece of a keyword to the keyword is joined with the pieces of distinct texts; what it proposes is verified
    by ``contains`` on the whole text. Each keyword is listed under its piece that the fewest keywords have, so no piece of common words
    holds most of them; pieces are long enough that numbered keywords do not share them, or a text's proposals would grow with the table.
    Pieces that begin like no listed one are left out before the shuffle. ``patterns`` are part of the plan. The points of a type are its keywords in the table (null and empty ones are
    left out, repeated ones count once for each type) and two for each pattern; patterns of a type that the table lacks count alone, after
    all others in ties. Ties go to the smallest type_pos, then to the first name. Null texts are as empty ones, and a text without any
    hit is unknown with 0. Clashing columns document_type and type_confidence are replaced."""
    patterns = {t: p for t, p in (patterns or {}).items() if p}
    known = keywords.select("document_type", "type_pos", F.lower("keyword").alias("keyword")).where("document_type IS NOT NULL AND keyword <> ''")
    known = known.groupBy("document_type", "keyword").agg(F.min("type_pos").alias("type_pos"))
    totals = known.groupBy("document_type").agg(F.min("type_pos").alias("type_pos"), F.count("*").alias("points"))
    if patterns:
        extra = docs.sparkSession.createDataFrame([(t, 2**31 - 1, 2 * len(p)) for t, p in patterns.items()], "document_type string, type_pos int, points long")
        totals = totals.unionByName(extra).groupBy("document_type").agg(F.min("type_pos").alias("type_pos"), F.sum("points").alias("points"))

    index = keyword_index(known)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[c for c in docs.columns if c not in ("document_type", "type_confidence")]).withColumn("_key", F.sha2(text, 256))
    texts = docs.select(F.sha2(text, 256).alias("_key"), text.alias("_text")).dropDuplicates(["_key"])
    starts = F.sequence(F.lit(1), F.greatest(F.length("_low"), F.lit(1)), F.lit(BLOCK))
    blocks = texts.withColumn("_low", F.lower("_text")).select("_key", F.explode(F.transform(starts, lambda at: F.substring(F.col("_low"), at, F.lit(BLOCK + GRAMS[0] - 1)))).alias("_block"))
    pieces = blocks.select("_key", F.explode(_grams(F.col("_block"))).alias("gram"))
    heads = index.select(F.substring("gram", 1, HEAD).alias("head")).distinct()
    if heads.limit(MAX_HEADS + 1).count() <= MAX_HEADS:
        pieces = pieces.join(F.broadcast(heads), F.substring("gram", 1, HEAD) == heads["head"], "left_semi")
    proposed = pieces.join(index, "gram").groupBy("_key").agg(F.collect_set("keyword").alias("_keywords"))

    low = F.lower("_text")
    judged = texts.join(proposed, "_key", "left").withColumn("_found", F.filter(F.coalesce("_keywords", F.array().cast("array<string>")), lambda k: F.contains(low, k)))
    hits = judged.select("_key", F.explode("_found").alias("keyword")).join(known.select("keyword", "document_type"), "keyword").select("_key", "document_type", F.lit(1).alias("n"))
    if patterns:
        points = [F.struct(F.lit(t).alias("document_type"), sum((F.col("_text").rlike("(?i)" + p).cast("int") * 2 for p in ps), F.lit(0)).alias("n")) for t, ps in patterns.items()]
        hits = hits.unionByName(texts.select("_key", F.inline(F.filter(F.array(*points), lambda h: h["n"] > 0))))
    scores = hits.groupBy("_key", "document_type").agg(F.sum("n").alias("n")).join(totals, "document_type")
    top = scores.groupBy("_key").agg(F.min(F.struct((-F.col("n") / F.col("points")).alias("less"), "type_pos", "document_type")).alias("_top"))
    score = F.coalesce(-F.col("_top.less"), F.lit(0.0))
    out = rows.join(top, "_key", "left")
    return out.withColumns({"document_type": F.when(score >= MIN_TYPE_SCORE, F.col("_top.document_type")).otherwise("unknown"), "type_confidence": score}).drop("_key", "_top")


def combine(cnn_type: Column, cnn_conf: Column, kw_type: Column, kw_conf: Column) -> Column:
    """Type by an image model if it is sure, else the surer of both."""
    image, words = F.struct(cnn_type.alias("type"), cnn_conf.alias("confidence")), F.struct(kw_type.alias("type"), kw_conf.alias("confidence"))
    return F.when((cnn_type != "unknown") & (cnn_conf >= 0.55), image).when(kw_conf > cnn_conf, words).when(cnn_conf > 0, image).otherwise(words)
