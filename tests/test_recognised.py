"""Recognised pages and the chain of engines; keyword tables of any size."""

import json

from pyspark.sql import functions as F

from veilmark.operators import classify
from veilmark.sources import recognised as R
from veilmark.sources import tables as T

BOX = [[10.9, 5], [30, 5.2], [30, 15.9], [10, 15]]


def test_pages_of_stored_output(spark):
    word = lambda t, c, x: {"symbols": [{"text": s} for s in t], "confidence": c, "bounding_box": {"vertices": [{"y": 1}, {"x": x, "y": 1}, {"x": x, "y": 9}, {"y": 9}]}}
    blocks = {"pages": [{"blocks": [{"paragraphs": [{"words": [word("ab", 0.5, 7.9)]}, {}]}, {"paragraphs": [{"words": [word("c", 1.0, 3)]}]}]}, {}], "text": "whole"}
    cases = [
        (1, [[BOX, [" Hi ", 0.9]], [BOX, ["  ", 0.1]], [BOX, ["you", 0.7]]], blocks, [[BOX, "Hi x", 0.9]]),
        (2, [], {"text": "only text"}, []),
        (3, [[[], ["a", 0.5]]], {"pages": [{"blocks": [{"paragraphs": [{"words": [{"symbols": [{"text": "a"}]}]}]}]}]}, [[None, "a", 0.5]]),
        (4, None, None, None),
    ]
    rows = spark.createDataFrame([(i, *[None if x is None else json.dumps(x) for x in xs]) for i, *xs in cases] + [(5, "{", "[", "nonsense")], "id int, a string, b string, c string")
    got = {r["id"]: r for r in rows.select("id", R.page_of_lines(F.col("a")).alias("a"), R.page_of_blocks(F.col("b")).alias("b"), R.page_of_triples(F.col("c")).alias("c")).collect()}
    assert got[1]["a"]["text"] == "Hi you" and [tuple(w) for w in got[1]["a"]["words"]] == [("Hi", 0.9, 10, 5, 20, 10), ("you", 0.7, 10, 5, 20, 10)]
    assert abs(got[1]["a"]["avg_confidence"] - 0.8) < 1e-12 and got[1]["a"]["n_words"] == 2
    assert [tuple(w) for w in got[1]["b"]["words"]] == [("ab", 0.5, 0, 1, 7, 8), ("c", 1.0, 0, 1, 3, 8)] and got[1]["b"]["text"] == "ab c"
    assert got[1]["c"]["text"] == "Hi x"
    assert got[2]["a"] is None and got[2]["b"]["text"] == "only text" and got[2]["b"]["n_words"] == 0 and got[2]["c"]["words"] == [] and got[2]["c"]["avg_confidence"] == 0
    assert [got[3][c] for c in "abc"] == [None] * 3 and [got[4][c] for c in "abc"] == [None] * 3
    assert got[5]["a"] is None and got[5]["c"] is None


def test_costlier_engines_see_the_remainder_only(spark):
    calls = [spark.sparkContext.accumulator(0) for _ in range(3)]

    def lines(image):
        calls[0].add(1)
        kind = image.decode()
        return None if kind.startswith("none") else [[BOX, ["w", 0.9 if kind == "good" else 0.5]]] * 6

    def blocks(image):
        calls[1].add(1)
        if image == b"fails":
            raise ValueError("no")
        word = {"symbols": [{"text": "v"}], "confidence": 0.4, "bounding_box": {"vertices": [{"x": 1, "y": 1}, {"x": 2, "y": 2}]}}
        return {"pages": [{"blocks": [{"paragraphs": [{"words": [word] * (5 if image == b"vision" else 1)}]}]}]} if image != b"none at all" else None

    def triples(image):
        calls[2].add(1)
        return [[BOX, "e", 0.3]] if image in (b"easy", b"none easy") else []

    kinds = ["good", "vision", "easy", "fails", "none", "none easy", "none at all", None]
    rows = spark.createDataFrame([(i, None if k is None else bytearray(k.encode()), "x") for i, k in enumerate(kinds * 20)], "id int, image binary, page string").repartition(3)
    out = R.recognise(rows, "image", *[R.engine(e) for e in (lines, blocks, triples)])
    got = {r["id"]: (r["page_engine"], r["page"]["text"]) for r in out.collect()}
    want = {"good": (1, "w w w w w w"), "vision": (2, "v v v v v"), "easy": (3, "e"), "fails": (1, "w w w w w w"), "none": (2, "v"), "none easy": (3, "e"), "none at all": (None, ""), None: (None, "")}
    assert got == {i: want[k] for i, k in enumerate(kinds * 20)}
    assert [c.value for c in calls] == [7 * 20, 6 * 20, 5 * 20]


def test_keyword_table_gives_what_the_plan_gives(spark, sf_dir):
    own = spark.createDataFrame([(9000, None), (9001, ""), (9002, "PAN uid " * 20_000 + "republic of INDIA"), (9002, "पता आधार"), (9003, "e")], "doc_id long, text string")
    docs = T.texts(spark, sf_dir).select("doc_id", "text").unionByName(own).withColumn("document_type", F.lit("clash"))
    patterns = {t: p for t, (_, p) in classify.KEYWORDS.items()}
    pick = lambda df: sorted((r["doc_id"], r["text"] or "", r["document_type"], round(r["type_confidence"], 12)) for r in df.select("doc_id", "text", "document_type", "type_confidence").collect())
    assert pick(classify.classify_by(docs, classify.keyword_table(spark), patterns)) == pick(classify.classify(docs))


def test_fifty_thousand_keywords(spark):
    """Keywords of all lengths; most share their pieces."""
    keywords = spark.range(50_000).selectExpr("concat('t', id % 10000) AS document_type", "cast(id % 10000 AS int) AS type_pos", "concat('Common Word ', id, '!') AS keyword")
    more = spark.createDataFrame([("short", -1, "é"), ("short", -1, "É"), ("two", -2, "ß4"), ("none", 0, None), ("none", 0, "")], "document_type string, type_pos int, keyword string")
    docs = spark.createDataFrame([(1, "see common word 7! and COMMON WORD 10007!"), (2, "café ß4"), (3, "common word"), (4, "x" * 70_000 + "common word 12345!"), (5, "")], "id int, text string")
    got = {r["id"]: (r["document_type"], round(r["type_confidence"], 9)) for r in classify.classify_by(docs, keywords.unionByName(more)).collect()}
    assert got == {1: ("t7", 0.4), 2: ("two", 1.0), 3: ("unknown", 0.0), 4: ("t2345", 0.2), 5: ("unknown", 0.0)}
    none = classify.classify_by(docs, more.limit(0))
    assert {(r["document_type"], r["type_confidence"]) for r in none.collect()} == {("unknown", 0.0)}


def test_numbered_keywords_do_not_share_pieces(spark):
    """A piece that many keywords are listed under is proposed with all of them for each text that has it."""
    index = classify.keyword_index(spark.range(30_000).selectExpr("concat('house ', id, ' ') AS keyword"))
    assert index.count() == 30_000
    assert index.groupBy("gram").count().agg({"count": "max"}).first()[0] == 1
