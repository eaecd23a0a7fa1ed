"""Input columns named like added ones, repeated rows and empty tables."""

import base64
import hashlib
from collections import Counter

from veilmark.llm import byte_bpe, quality_classifier, quality_rules, url_filter, warc


def test_url_filter_replaces_clashing_columns_and_keeps_repeats(spark):
    urls = [None, None, "x://a.com/en/1", "x://a.com/en/1", "x://a.com/en/1", "y://other", "no scheme"]
    rows = spark.createDataFrame([(i % 3, u, 5, 6.0, "mine", True) for i, u in enumerate(urls)], "page_id long, url string, host int, path double, rule string, verdict boolean")
    got = url_filter.judge(rows, url_filter.rules_table(spark))
    assert sorted(got.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    plain = Counter((u, i % 3) for i, u in enumerate(urls))
    found = got.collect()
    assert Counter((r["url"], r["page_id"]) for r in found) == plain
    assert {r["verdict"] for r in found if r["url"] == "x://a.com/en/1"} == {"block"} and {r["host"] for r in found if r["url"] is None} == {""}
    assert url_filter.op5_url_filter(rows.where("1 = 0")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(rows, url_filter.rules_table(spark).where("1 = 0")).collect()} == {"allow"}


def test_url_filter_has_the_rules_of_its_contract(spark):
    urls = ["x://a.net/de/1", "x://net/de/", "x://example.net/de/7", "x://b.example.net/de/81", "x://a.com/en/", "x://example.com/en/7", "x://a.org/es/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.op5_url_filter(rows).orderBy("page_id").collect()]
    assert got == [("net/de/", "allow")] * 3 + [("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block")]


def test_warc_rows_are_counted(spark):
    """Repeated rows get a record each; equal payloads refer to the smallest page."""
    rows = [(5, "one"), (3, "one"), (3, "one"), (3, "one"), (7, None), (7, ""), (9, "two"), (None, "two"), (None, "two")]
    pages = spark.createDataFrame([(i, t, "u", 1) for i, t in rows], "page_id long, html string, url string, digest int")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.op7_warc(pages).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert got == Counter((i, len((t or "").encode()), digest(t)) for i, t in rows)
    found = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.op7_warc(pages).collect()}
    assert (5, "revisit", 3) in found and (3, "response", None) in found and (9, "response", None) in found


def test_byte_bpe_replaces_clashing_columns(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([(1, "a text", 3, True), (1, "a text", 3, True), (2, None, 4, None)], "doc_id long, text string, token_ids int, decoded boolean")
    coded = byte_bpe.encode(rows, path, public_tokenizers.PATTERN)
    found = byte_bpe.decode(coded, path).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in found) == Counter({(1, b"a text"): 2, (2, b""): 1})


def test_quality_operators_replace_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, words, "n", 7, "x"), (1, words, "n", 7, "x"), (2, None, None, None, None)], "doc_id long, text string, kept string, n_words int, within string")
    assert Counter(map(tuple, quality_rules.op4_quality_rules(rows).select("doc_id", "n_words", "kept").collect())) == Counter({(1, 60, True): 2, (2, 0, False): 1})
    scored = quality_classifier.predict(spark.createDataFrame([(1, "a", "old"), (1, "a", "old"), (2, None, None)], "doc_id long, text string, score string"), (None, 0.0))
    assert sorted((r["doc_id"], r["score"]) for r in scored.collect()) == [(1, 0.5), (1, 0.5), (2, 0.5)]
