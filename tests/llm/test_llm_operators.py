"""The dealt operators against plain Python on a small fixture and on the smallest tables."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilmark.llm import byte_bpe, decontamination, jaccard_join, language_id, licenses, pii, quality_classifier, quality_rules, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, words string, h long"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
TEXTS = [
    None, "", " \n\t ", "one", "Under the MIT License, under the mit-license. CC BY NC!", "x apache LICENSE version 2 y", LONG, LONG + " tail", "a b c a b c a b c\na b c a b c a b c\n\n# * $",
    "mail a.b@c.d.org, x@y or @z.com; ip 10.0.0.1 and 999.1.1.1 and 1.2.3.4.5; card 4111 1111 1111 1111; call +1 (555) 010-9999 now", "ünïcode ß 日本語 😀 +49 30 1234567 é@x.de", "aaaa@@bb.cc a@b.c@d.e 0.0.0.0 4111111111111112",
    "tie one two three four five", "tie one two three four five", "!!! ??? ...", "\r\n\r\nx\r\n",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "hot", len(t or ""), 1, None, "w", 5) for i, t in enumerate(TEXTS)]
    rows.append(rows[9])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def both(docs, sample):
    return [(r["doc_id"], r["text"]) for d in (docs, sample) for r in d.select("doc_id", "text").collect()]


def rows_of(query, docs, sample):
    return [r for d in (docs, sample) for r in query(d).collect()]


def test_licenses(docs, sample, nothing):
    want = Counter()
    for i, t in both(docs, sample):
        w = alnum(t)
        hits = sorted((p, label) for label, phrase in licenses.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        want[i, len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x[1] for x in hits}))] += 1
    got = rows_of(licenses.op1_license_scan, docs, sample)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert licenses.op1_license_scan(nothing).count() == 0


def test_license_notice_with_changes(spark):
    text = licenses.NOTICES[0][1].replace("obtaining a copy", "who gets hold of a copy")
    row = licenses.op1_license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["labels"], row["base_labels"]) == ("mit", "")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_personal_data(docs, sample, nothing):
    want = Counter()
    for i, t in both(docs, sample):
        spans = base_spans(t)
        n = Counter(s[0] for s in spans)
        want[i, *[n[k] for k in pii.KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    got = rows_of(pii.op3_pii, docs, sample)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) for r in got) == want
    assert pii.op3_pii(nothing).count() == 0


def test_redaction(docs):
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "a.b@c.d.org" not in got[9] and "[EMAIL]" in got[9] and "4111 1111" not in got[9]
    assert all(got[i] == TEXTS[i] for i in (0, 1, 2, 3, 7, 12))


def test_quality_rules(docs, sample, nothing):
    want = Counter()
    for i, t in both(docs, sample):
        w = spaced(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if spaced(x)]
        want[i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    got = rows_of(quality_rules.op4_quality_rules, docs, sample)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == want
    assert not any(r["base_failed"] and r["kept"] for r in got)
    assert quality_rules.op4_quality_rules(nothing).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Sub.Example.COM/en/7x?q#f", "http://example.com/en/1", "http://xexample.com/en/7", "https://a.net/de/8", "ftp://example.net/de/81", "x://org/es/", "x://org", "x:///en/", "a://b://com/en/"]
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame([(u, 1) for u in urls], "url string, n int"), url_filter.rules_table(spark)).collect()}
    assert got[None] == ("", "", None, "allow")
    assert got["http://Sub.Example.COM/en/7x?q#f"] == ("sub.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got["http://example.com/en/1"][2:] == ("com/en/", "block")
    assert got["http://xexample.com/en/7"][2:] == ("com/en/", "block")
    assert got["ftp://example.net/de/81"][2:] == ("example.net/de/8", "block")
    assert (got["x://org/es/"][3], got["x://org"][3], got["x:///en/"][0]) == ("block", "allow", "")


def test_decontamination(spark, sf_dir, docs, sample, nothing):
    items = table(spark, sf_dir, "benchmark").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "tie one"), (9003, "tie one")], "item_id long, text string"))
    rows, want = both(docs, sample), set()
    for item, t in {(r["item_id"], r["text"]) for r in items.collect()}:
        w = alnum(t)
        k = min(5, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i, text in rows:
            d = alnum(text)
            n = len(own & {tuple(d[j : j + k]) for j in range(len(d) - k + 1)})
            if own and 5 * n >= 4 * len(own):
                want.add((i, item, n, len(own)))
    got = [r for d in (docs, sample) for r in decontamination.op6_decontamination(d, items).collect()]
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got} == want
    assert decontamination.op6_decontamination(nothing, items).count() == 0
    assert decontamination.op6_decontamination(docs, items.where("false")).count() == 0


def test_warc_round_trip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "é\r\n\r\nx"), (903, "é\r\n\r\nx"), (None, "lone")], "page_id long, html string"))
    first, rows = {}, [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    for i, p in rows:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    want = {(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if first.get(p, i) == i else ("revisit", first[p]))) for i, p in rows}
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.op7_warc(pages).collect()}
    assert got == want
    assert warc.op7_warc(pages.where("false")).count() == 0


def test_byte_bpe(docs, sample, nothing):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in both(docs, sample):
        ids = coder.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows_of(byte_bpe.op8_byte_bpe, docs, sample))) == want
    assert byte_bpe.op8_byte_bpe(nothing).count() == 0


def shingles(t):
    w = spaced(lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def components(rows):
    """doc_id: (set size, smallest linked doc_id), by counting what sets share."""
    sets = {i: shingles(t) for i, t in rows}
    holders, lead = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                lead[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard_join(spark, docs, sample, nothing):
    for d in (docs, sample):
        want = components([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()])
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op9_jaccard_join(d).collect()} == want
    assert jaccard_join.op9_jaccard_join(nothing).count() == 0


def test_jaccard_join_near_the_threshold(spark):
    rng, rows = random.Random(3), []
    for size in (6, 9, 14, 25, 60, 200):
        for _ in range(6):
            words = [f"v{rng.randrange(10**6)}" for _ in range(size + 4)]
            rows.append(words)
            for _ in range(4):
                copy = list(words)
                for _ in range(rng.randrange(1, 2 + size // 25)):
                    copy[rng.randrange(len(copy))] = f"u{rng.randrange(10**6)}"
                rows.append(copy if rng.random() < 0.5 else copy[: -rng.randrange(1, 2 + size // 8)])
    numbered = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = jaccard_join.link_documents(spark.createDataFrame(numbered, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(numbered)


def test_language_id(spark, sf_dir, docs, sample, nothing):
    got = {r["doc_id"]: r for r in language_id.op2_language_id(sample).collect()}
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in sample.where("lang is not null").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    small = language_id.op2_language_id(docs).collect()
    assert len(small) == docs.count()
    assert {r["doc_id"] for r in small if r["lang_pred"] == "und"} >= {0, 1, 2, 14}
    assert language_id.op2_language_id(nothing).count() == 0


def test_quality_classifier(spark, docs, nothing):
    base = "/root/testdata/sf0.01"
    rows, labels = table(spark, base, "documents"), table(spark, base, "labels")
    got = quality_classifier.op10_quality_classifier(rows, labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.85 * len(got)
    scored = quality_classifier.op10_quality_classifier(docs, labels.where("false")).collect()
    assert len(scored) == docs.count() and all(r["score"] == 0.5 for r in scored)
    assert quality_classifier.op10_quality_classifier(nothing, labels).count() == 0


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        ids = [r[0] for r in docs.select("doc_id").collect()]
        assert {*ids} <= {r[0] for r in before.select("doc_id").collect()}, name
        if name != "tokens":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            linked = components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(ids) == sorted(i for i, (_, c) in linked.items() if c == i)
    assert docs.where(~F.col("round_trip")).count() == 0


def test_merge_replay():
    """Random texts and random strings of tokens, of which many have merges that make room for earlier ones."""
    import public_tokenizers
    import tiktoken

    tokens = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    replay = byte_bpe.MergeReplay(tokens, public_tokenizers.PATTERN)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=replay.ranks, special_tokens={})
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcé日\U0001f600 \n1A'") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += ["", "é" * 32, "x" * 65, "a" * 3000, " " * 200, "aaaa bbbb" * 50]
    long = [t for t in tokens if len(t) > 2]
    texts += [b"".join(rnd.choice(long)[: rnd.randint(1, 9)] for _ in range(rnd.randint(1, 6))).decode("utf-8", "ignore") for _ in range(2000)]
    want = [b"".join(i.to_bytes(4, "little") for i in whole.encode_ordinary(t)) for t in texts]
    assert replay.encode(texts) == want
    assert replay.encode(texts) == want  # from memory
