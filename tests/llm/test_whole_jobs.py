"""Cases where an operator once did less than its whole job."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm import decontamination, features, jaccard_join, language_id, licenses, pii, quality_rules


def test_hot_bucket_is_cut_into_blocks(spark):
    rows = spark.range(2500).select(F.lit(7).alias("sig"), F.col("id").alias("class"), F.lit(5).alias("parts"))
    met = jaccard_join.bucket_blocks(rows)
    tasks = met.groupBy("sig", "lo", "hi").count().collect()
    assert len(tasks) == 15 and max(r["count"] for r in tasks) < 1250
    pairs = met.alias("x").join(met.alias("y"), ["sig", "lo", "hi"]).where("x.class < y.class and (lo = hi or x.block <> y.block)")
    assert pairs.count() == pairs.select("x.class", "y.class").distinct().count() == 2500 * 2499 // 2


def test_unlinked_templated_documents(spark, monkeypatch):
    """One template, 80 % of each text: buckets are large and hardly anything links; blocks find what links."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 8)
    rng = random.Random(5)
    template = [f"t{i}" for i in range(160)]
    texts = [[*template, *(f"o{rng.randrange(10**9)}" for _ in range(44))] for _ in range(60)]
    for i in (7, 31, 44):
        texts.append([*texts[i][:-3], "x", "y", "z"])
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_documents(rows).collect()}
    assert got == {i: i for i in range(60)} | {60: 7, 61: 31, 62: 44}


def test_bootstrap_finds_what_no_base_rule_matches(spark):
    """'call' is learnt from base phones, what it finds teaches 'dial' in the next round; 'room' stays unknown."""
    local = [f"555-01{i}-9999" for i in range(10)]
    texts = [f"call +1-555-{100 + i}-9999" for i in range(100)] + [f"call {v}" for v in local] + [f"dial {v}" for v in local]
    texts += ["dial 0170-12345", "room 0170-12345-1"]
    texts += [f"10.0.0.{i} responded" for i in range(9)] + ["10.0.0.999 responded"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.op3_pii(rows).collect()}
    assert {got[i] for i in range(100, 121)} == {"phone:5:17", "phone:5:15"} and got[120] == "phone:5:15"
    assert got[121] == "" and got[len(texts) - 1] == "ip:0:10"


def labels(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.op1_license_scan(rows).collect()}


def test_stray_diagonal_does_not_part_a_notice(spark):
    """The notice repeats 'the license you may', which votes for far diagonals between its two halves."""
    text = dict(licenses.NOTICES)["apache-2"].replace("in compliance", "in full compliance")
    found, score = labels(spark, [text])[0]
    assert "apache-2" in found.split(",") and score >= licenses.COVERAGE
    twice = licenses.scan_licenses(spark.createDataFrame([(1, f"{text} x {text}")], "doc_id long, text string")).first()["spans"]
    assert [(s["start"], s["end"]) for s in twice if not s["base"]] == [(0, 32), (33, 65)]


def test_notices_are_verified(spark):
    """Every notice has its own label only: as it is, with an inserted and with a dropped word; a sibling has none of theirs."""
    texts, want = [], []
    for label, text in licenses.NOTICES:
        words = text.split()
        half = len(words) // 2
        for changed in (words, [*words[:half], "quite", *words[half:]], [*words[:half], *words[half + 1 :]]):
            texts.append(" ".join(changed))
            want.append(label)
    texts += ["this work is licensed under a creative commons attribution noncommercial 4 0 international license", "a b c licensed under the x"]
    want += ["", ""]
    got = labels(spark, texts)
    assert [(texts[i], got[i][0]) for i in range(len(texts))] == list(zip(texts, want, strict=True))


def test_pipeline_drops_rows_by_doc_id_and_text(spark, sf_dir):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    schema = "doc_id long, text string"
    rows = spark.createDataFrame([(1, a), (1, a), (2, a), (2, b), (None, a), (None, c), (None, c)], schema)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, rows, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (None, c)], key=repr)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text <> ''").first()["text"]
    rows = spark.createDataFrame([(5, item), (5, a), (None, item), (None, b)], schema)
    got = [tuple(r) for r in corpus_pipeline.decontaminate(spark, rows, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([(5, a), (None, b)], key=repr)


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark):
    """Scores are those of a plain naive Bayes, whatever stands beside a text; ties go to the first language; clashing columns are replaced."""
    texts = ["die", "the house", "zzz qqq", "das haus und die katze", "the cat and the house", "", None, "12 !"]
    train = spark.createDataFrame([("de", "das haus die katze"), ("en", "the house the cat"), (None, "x"), ("en", None)], "lang string, text string")
    model = language_id.fit(train)
    rows = spark.createDataFrame([(i, t, "old", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score int")
    together = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language_id.predict(rows.coalesce(1), model).collect()}
    for i in (0, 1, 3):
        alone = language_id.predict(rows.where(rows["doc_id"] == i), model).first()
        assert (alone["lang_pred"], round(alone["score"], 6)) == together[i]
    langs, logp = model
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            total = np.zeros(len(langs))
            codes, _ = features.codes([text])
            for k, n in enumerate(language_id.ORDERS):
                total += sum(logp[:, int(b) + (k << language_id.BITS)].astype(float) for b in features.char_ngrams(codes, n, language_id.BITS)[: len(text)])
            want = langs[int(total.argmax())], round(float(1 / np.exp(total - total.max()).sum()), 6)
            assert (together[i][0], together[i][1]) == (want[0], pytest.approx(want[1], abs=1e-4))
        else:
            assert together[i] == ("und", 0.0)


def exact_fence(values, groups, row, n, event):
    """Fence of a row from exact quantiles: ``groups`` are its group, its language and all, as lists of rows."""
    at = lambda rows, q: sorted(values[j] for j in rows)[max(math.ceil(q * len(rows)) - 1, 0)]
    low, mid, high, top = [], [], [], []
    for out, q in ((low, 0.25), (mid, 0.5), (high, 0.75), (top, 0.9)):
        own, lang, whole = (at(rows, q) for rows in groups)
        a, b = (len(rows) / (len(rows) + 200) for rows in groups[:2])
        out.append(a * own + (1 - a) * (b * lang + (1 - b) * whole))
    spread = max((high[0] - low[0]) / 1.349, (top[0] - mid[0]) / 1.2816)
    return high[0] + 4 * math.sqrt(spread**2 + high[0] * event / n + (event / n) ** 2)


def test_quality_verdicts_with_exact_quantiles(spark):
    """Groups of every size, down to one row, have fences; sketches of so few rows are exact."""
    rng = random.Random(2)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)] + ["#$%"] * rng.choice([0] * 20 + [1, 2, 40]) + ["Ab!"] * rng.choice([0] * 20 + [3, 50])
        lines = " ".join(words) + "\nsame line" * rng.choice([0] * 20 + [1, 2, 30])
        rows.append((i, lines, rng.choice(("en", None)), rng.choice(("a", "b", None)) if i else "alone", 1.0, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, symbol_ratio double, n_words string")
    got = {r["doc_id"]: r for r in quality_rules.filter_quality(docs).collect()}
    shares = {"symbol_ratio": ("n_symbols", "n_words", 1), "dup_line_ratio": ("n_dup_lines", "n_lines", 1), "repeat_ratio": ("n_repeat_words", "n_words", 6), "upper_ratio": ("n_upper", "word_chars", 1), "bang_ratio": ("n_bang", "n_words", 1)}
    failed = Counter()
    for i, _, lang, source, *_ in rows:
        groups = [j for j, _, a, b, *_ in rows if (a, b) == (lang, source)], [j for j, _, a, *_ in rows if a == lang], list(got)
        fits = True
        for m, (count, units, event) in shares.items():
            values = {j: r[count] / max(r[units], 1) for j, r in got.items()}
            fence = exact_fence(values, groups, i, max(got[i][units], 1), event)
            assert got[i][f"fence_{m}"] == pytest.approx(fence)
            failed[m] += values[i] > fence
            fits &= values[i] <= fence
        assert got[i]["kept"] == (fits and not got[i]["base_failed"]), i
    assert sum(f > 0 for f in failed.values()) >= 2 and 0 < sum(not r["kept"] for r in got.values()) < 75
    assert quality_rules.filter_quality(docs.drop("lang", "source")).count() == 150


def test_quality_verdict_follows_its_group(spark):
    """One and the same text is junk where no other has symbols, and is kept where many have; so no fixed cutoffs give these verdicts."""
    rng = random.Random(7)
    plain = lambda symbols: " ".join([f"w{rng.randrange(10**6)}" for _ in range(100)] + ["|"] * symbols)
    table = plain(40)
    rows = [(i, plain(0), "en", "news") for i in range(1000)] + [(1000 + i, plain(rng.randrange(60)), "en", "tables") for i in range(90)]
    rows += [(5000, table, "en", "news"), (5001, table, "en", "tables"), (5002, table, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.filter_quality(docs).collect()}
    assert not got[5000]["kept"] and got[5001]["kept"]
    assert all(r["kept"] for i, r in got.items() if i < 1000) and sum(r["kept"] for i, r in got.items() if 1000 <= i < 2000) > 50


def test_quality_fence_allows_for_a_texts_length(spark):
    """One repeated line of three fails no short text; the same share of a long text is beyond what chance does."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = words(30)
    rows = [(i, "\n".join(words(20) for _ in range(5)), "en", "a") for i in range(300)]
    rows += [(1000, f"{line}\n{words(30)}\n{line}", "en", "a"), (1001, "\n".join([words(30) for _ in range(200)] + [line] * 101), "en", "a")]
    got = {r["doc_id"]: r for r in quality_rules.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1000]["dup_line_ratio"] == pytest.approx(got[1001]["dup_line_ratio"], abs=0.01)
    assert got[1000]["dup_line_ratio"] <= got[1000]["fence_dup_line_ratio"] and got[1001]["dup_line_ratio"] > got[1001]["fence_dup_line_ratio"]
    assert all(r["kept"] for i, r in got.items() if i < 1000) and not got[1001]["kept"]


def test_secrets_and_their_spans(spark):
    """Assigned secrets are seeds; what they teach finds secrets of the same shape under other names; numbers elsewhere stay."""
    rng = random.Random(4)
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "7a"
    texts = [f'x token = "{value()}" y' for _ in range(12)] + [f'auth = "{value()}"', "version = 4.0.", "see 12 of 30", f"id={value()}"]
    rows = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = [(r["doc_id"], r["spans"], r["n_spans"]) for r in pii.op3_pii(rows).collect()]
    at = texts[0].index('"') + 1
    assert got.count((0, f"secret:{at}:{at + 41}", 1)) == 2
    found = {i: s for i, s, _ in got}
    assert found[12] == "secret:8:49" and found[13] == found[14] == ""
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    assert redacted[0] == 'x token = "[SECRET]" y' and redacted[13] == texts[13]


def test_redaction_of_many_identifiers(spark):
    text = " ".join(f"é{i} a{i}@b{i}.org" for i in range(1000))
    row = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["text"] == " ".join(f"é{i} [EMAIL]" for i in range(1000))


def test_decontamination_judges_texts_apart(spark):
    """Two halves under one doc_id do not hold an item together; two texts of one item_id are two items; null identifiers name nothing."""
    words = [f"w{i}" for i in range(40)]
    item, other = " ".join(words), " ".join(f"o{i}" for i in range(40))
    docs = spark.createDataFrame([(1, " ".join(words[:22])), (1, " ".join(words[18:])), (2, item), (2, item), (3, f"x {other} y"), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, other), (7, item), (None, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination.contaminated(docs, items).collect())
    assert got == [(2, 7, 36, 36, 1.0), (3, 7, 36, 36, 1.0)]


def test_one_text_of_very_many_identifiers(spark):
    """Time goes with the identifiers: ten times as many take at most some twenty times as long, where their square would take a hundred."""
    import time

    def text(n):
        return " ".join(f"mail a{i}@b{i}.org now" for i in range(n))

    took = {}
    for n in (10, 10_000, 100_000):  # the first run compiles
        began = time.time()
        r = pii.op3_pii(spark.createDataFrame([(1, text(n))], "doc_id long, text string")).first()
        took[n] = time.time() - began
        assert (r["n_email"], r["n_spans"]) == (n, n)
        assert r["spans"].endswith(f":{len(text(n)) - 4}")
    assert took[100_000] < 20 * took[10_000]


def test_components_of_further_edges(spark, monkeypatch):
    """Components that are known are not gone through again: only edges between them are, once each, and the result is that of all edges."""
    from veilmark.llm import common

    first = [(0, i) for i in range(1, 300)] + [(1000, i) for i in range(1001, 1300)] + [(2000, 2001)]
    further = [(i, 1000 + i) for i in range(1, 200)] + [(5, 6), (3000, 2001), (4000, 4001)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = common.connected_components(frame(first)).cache()
    given = []
    whole = common.connected_components
    monkeypatch.setattr(common, "connected_components", lambda edges: given.append(edges.where("a <> b").distinct().count()) or whole(edges))
    got = common.joined_components(known, frame(further)).collect()
    assert given == [3]
    assert sorted(got) == sorted(whole(frame(first + further)).collect())


def test_tokens_take_one_python_task(spark, sf_dir, capsys):
    """The pipeline's last stage encodes and decodes in one Python task, with the ids and bytes that two give; its rows hold numbers of 32 bits."""
    import public_tokenizers

    import corpus_pipeline
    from veilmark.llm import byte_bpe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    corpus_pipeline.tokens(spark, docs, sf_dir).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    one = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    two = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    assert one.columns == two.columns and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    replay = byte_bpe.MergeReplay(byte_bpe.load_ranks(path), public_tokenizers.PATTERN)
    assert replay.look_up(replay.byte_table[:9], replay.byte_table[1:10]).dtype == np.int32
