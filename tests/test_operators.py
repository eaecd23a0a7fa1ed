"""Hand fixtures of single functions."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions import rules
from veilmark.functions.scalars import first_match, mask, mask_display, risk_label, words
from veilmark.operators import detect, fuzzy, geometry, policy


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "pattern", "want"), [
    ("+91 9876543210", rules.PHONE, "9876543210"), ("+919876543210", rules.PHONE, None), ("x+91-9876543210", rules.PHONE, "+91-9876543210"),
    ("Blood O+ x", rules.BLOOD, None), ("O+x", rules.BLOOD, "O+"), ("vitamin-a-day", rules.BLOOD, "a-"), ("", rules.EMAIL, None),
])
def test_patterns(spark, text, pattern, want):
    assert value(spark, first_match(F.lit(text), pattern)) == want


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_window(text, template, threshold):
    tokens, best, top = text.split(), None, threshold
    for n in range(1, 6):
        for i in range(len(tokens) - n + 1):
            joined = "".join(tokens[i : i + n])
            score = 200.0 * plain_lcs(joined, template) / (len(joined) + len(template))
            if score > top:
                best, top = (" ".join(tokens[i : i + n]), score / 100, i, n), score
    return best


def test_common_subsequences(spark):
    """By the bits of a number, and beyond 62 characters by rows of the table; both as the plain table gives."""
    rng = random.Random(1)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    rows = [(text(rng.randrange(14), "ab0A é"), text(rng.randrange(14), "ab0A")) for _ in range(300)]
    rows += [(text(rng.randrange(90), "ab0A"), text(n, "ab0A")) for n in (61, 62, 63, 64, 80, 90)] + [("", ""), ("a", ""), ("", "a")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fuzzy.lcs_length(F.col("a"), F.col("b")).alias("n"), fuzzy.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r["n"] == plain_lcs(r["a"], r["b"])
        assert r["r"] == (pytest.approx(200 * r["n"] / (len(r["a"]) + len(r["b"]))) if r["a"] + r["b"] else 100)
    assert value(spark, fuzzy.indel_ratio(F.lit("ABCDE1234F"), F.lit(rules.TEMPLATES[rules.PAN]))) == pytest.approx(20.0)


def test_best_windows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("0A12") for _ in range(rng.randrange(1, 6)))
    rows = [(" ".join(word() for _ in range(rng.randrange(12))), rng.choice(("0000 0000 0000", "AAAAA0000A", "AAA0000000")), rng.choice((40.0, 50.0, 60.0, 80.0))) for _ in range(300)]
    rows += [("00000000000", rules.TEMPLATES[rules.AADHAAR], 85.0), ("AAA0-97", rules.TEMPLATES[rules.EPIC], 80.0), ("tie 000 tie 000", "000", 10.0), ("", "A", 0.0)]
    df = spark.createDataFrame(rows, "text string, template string, threshold double")
    found = 0
    for r in df.select("*", fuzzy.best_window(words(F.col("text")), F.col("template"), F.col("threshold")).alias("best")).collect():
        want = plain_window(r["text"], r["template"], r["threshold"])
        found += want is not None
        assert (r["best"] and tuple(r["best"])) == (want and (want[0], pytest.approx(want[1]), *want[2:]))
    assert found > 40
    none = df.select(fuzzy.best_window(words(F.lit(None).cast("string")), F.lit("A"), F.lit(0.0)).alias("x"), fuzzy.best_window(words(F.lit("a")), F.lit(None).cast("string"), F.lit(0.0)).alias("y")).first()
    assert none["x"] is None and none["y"] is None


def test_windows(spark):
    """Every window once, whatever the number of words is beside a block's."""
    texts = [None, "", " \n ", "a", "a a a a a a a", " é\tb  c\n"] + [" ".join(f"w{i % 7}" for i in range(k * fuzzy.BLOCK + m)) for k in (1, 2, 5) for m in (-1, 0, 1, 3, 4, 5)]
    got = fuzzy.window_candidates(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()
    parts = [(d, (t or "").split()) for d, t in enumerate(texts)]
    want = [(d, n, i, " ".join(w[i : i + n])) for d, w in parts for n in range(1, fuzzy.MAX_WORDS + 1) for i in range(len(w) - n + 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_windows_are_written_small(spark, sf_dir, tmp_path):
    """The rows are as many as the contract asks for, but their order takes a third off the files that hold them by number of words, then place."""
    rows = fuzzy.window_candidates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = {}
    for name, df in (("as listed", rows), ("by n", rows.sortWithinPartitions("doc_id", "n", "start"))):
        df.write.option("compression", "snappy").parquet(str(tmp_path / name))
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert size["as listed"] < 0.75 * size["by n"]


def test_extraction_is_one_projection(spark):
    """Fields, scores and boxes of a document need no shuffle, no join and no Python."""
    rows = spark.range(10).selectExpr("id AS doc_id", "'pan' AS document_type", "'kyc_onboarding' AS context", "concat('PAN ABCDE1234', id) AS text")
    found = detect.with_fields(rows)
    judged = found.withColumn("fields", policy.judged(F.col("fields"), F.col("document_type"), F.col("context")))
    decided = judged.withColumn("fields", policy.decided(F.col("fields"), F.create_map(F.lit("name"), F.lit("allow"))))
    page = geometry.layout(words(F.col("text")))
    whole = decided.select("doc_id", policy.exposure_of(F.col("fields")), F.inline(geometry.boxed(F.col("fields"), page, F.lit(True), policy.DECIDED)))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Join", "Python", "Arrow"))


def test_fields_of_unknown_documents(spark):
    """Patterns first, then a name and an address; values that are there already do not count again, blacklisted names never."""
    kind = "array<struct<entity_group:string,word:string,score:double,start:int>>"
    rows = [(1, "call 9876543210 asha rao pune", [("PER", "Income Tax", 0.99, 0), ("PER", "asha rao", 0.8, 16), ("LOC", "pune", 0.5, 25)]), (2, "9876543210", [("PER", "9876543210", 0.9, 0), ("LOC", None, 0.9, 0)]), (3, None, None), (4, "ASHA asha", [("PER", "ASHA", 0.9, 0), ("LOC", "asha", 0.9, 5)])]
    df = spark.createDataFrame([(i, t, e, "unknown") for i, t, e in rows], f"doc_id long, text string, entities {kind}, document_type string")
    got = {r["doc_id"]: [(f["field_name"], f["value"], round(f["confidence"], 6), f["weight"], f["method"]) for f in r["fields"]] for r in detect.with_fields(df, entities_col="entities").collect()}
    assert got == {1: [("phone", "9876543210", 0.85, 6, "regex_fuzzy"), ("name", "asha rao", 0.56, 5, "ner"), ("address", "pune", 0.35, 5, "ner")], 2: [("phone", "9876543210", 0.85, 6, "regex_fuzzy")], 3: [], 4: [("name", "ASHA", 0.63, 5, "ner")]}


def test_scores_of_arrays(spark):
    """The folds give what sums over rows give."""
    rng = random.Random(3)
    fields = [[(k, f"f{k}", rng.randrange(1, 9), rng.random() < 0.3, rng.random() < 0.5, rng.choice(("allow", "mask", None))) for k in range(rng.randrange(6))] for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(fields)), "id int, fields array<struct<rule_pos:int,field_name:string,weight:int,always_redact:boolean,required:boolean,submitted:string>>")
    for r in df.select("id", policy.exposure_of(F.col("fields")).alias("a"), policy.exposure_of(F.col("fields"), policy.exposed).alias("b")).collect():
        for got, rows in ((r["a"], fields[r["id"]]), (r["b"], [f for f in fields[r["id"]] if f[5] == "allow" and not f[3]])):
            most = sum(10 * w for _, _, w, *_ in rows)
            total = sum(w * 10 if always or not needed else w * 2 for _, _, w, always, needed, _ in rows)
            assert got == pytest.approx(100 * total / most if most else 0, abs=0.051)


def test_glued_anchor(spark):
    assert value(spark, detect.anchored_match(F.lit("PANABCDE1234F"), rules.PAN, ["pan"])) == "ABCDE1234F"


def test_highlight_nests(spark):
    fields = F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(v).alias("value")) for n, v in (("email", "a@b.co"), ("name", "a"))])
    assert value(spark, detect.highlight(F.lit("x a@b.co"), fields)) == "x [em[name:a]il:[name:a]@b.co]"


def test_masks(spark):
    assert [value(spark, f(F.lit(v))) for f in (mask, mask_display) for v in ("abcd", "abcde")] == ["****", "abcd****", "abcd", "abcd****"]
    assert [value(spark, risk_label(F.lit(x))) for x in (60, 30, 29.9)] == ["high", "medium", "low"]


def test_extract_fields_of_nothing(spark):
    rows = spark.createDataFrame([(1, None, "unknown"), (2, "", "pan"), (3, None, None)], "doc_id long, text string, document_type string")
    assert [tuple(r) for r in detect.extract_fields(rows).select("doc_id", "field_name").collect()] == [(2, "signature")]


def test_necessity_size():
    rows = rules.necessity_rows()
    assert (len(rows), sum(r[3] for r in rows)) == (150, 58)
