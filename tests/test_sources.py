"""Sources, sinks, streams and the column functions that no query calls."""

import json
import zlib

from pyspark.sql import functions as F

from veilmark.functions import rules
from veilmark.functions.scalars import js_round
from veilmark.operators import classify, detect, policy, redact
from veilmark.sources import tables as T
from veilmark.streaming.scan_stream import append_stream, scan_stream


def test_files_and_uploads(spark, tmp_path):
    folder = tmp_path / "passport"
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo")
    (folder / "b.PNG").write_bytes(b"\x89PNG")
    (folder / "c.gif").write_bytes(b"GIF")
    assert [r["text"] for r in T.text_files(spark, str(folder / "a.txt")).collect()] == ["one\ntwo"]
    assert [(r["label"], r["filename"]) for r in T.uploads(spark, str(folder)).collect()] == [("passport", "b.PNG")]


def test_cards_are_dealt_out(spark, tmp_path):
    """One file of customers, which is one task to read, gives tasks by the number of cards; each customer keeps its card."""
    folder = f"{tmp_path}/large"
    spark.range(25_000).selectExpr("if(id < 20000, 7, id) AS c_custkey").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    cards = T.id_cards(spark, folder)
    sizes = [r["n"] for r in cards.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    assert len(sizes) >= 3 and sum(sizes) == 25_000 and max(sizes) <= T.ROWS_A_TASK
    assert cards.where("doc_id = 7").count() == 20_000 and cards.select("doc_id").distinct().count() == 5_001


def test_later_steps_are_taken_for_unsettled_rules_only(spark):
    """A step that would fail is not taken for a text whose rule an early step has settled."""
    fails = F.raise_error(F.concat(F.lit("taken for "), "text")).cast("string")
    late = lambda text: F.when(text != "late ABC", fails).otherwise("late")
    one = lambda text: detect._steps([F.lit(0).alias("rule_pos"), F.lit("f").alias("field_name"), F.lit(1).alias("weight"), F.lit(False).alias("always_redact")], [detect._step(detect._first(text, F.lit("ABC 1")), 0.95, "a")], [detect._step(late(text), 0.5, "b")], F.lit(None).cast("string"), F.lit(0.0))
    rows = spark.createDataFrame([("ABC 1",), ("late ABC",)], "text string").repartition(1).select("text", one(F.col("text")).alias("o"))
    assert {r["text"]: (r["o"]["early"] and r["o"]["early"]["value"], r["o"]["later"] and r["o"]["later"]["value"]) for r in rows.collect()} == {"ABC 1": ("ABC 1", None), "late ABC": (None, "late")}


def test_choice_of_recognition(spark):
    kind = "struct<text:string,avg_confidence:double,n_words:int>"
    good, weak, none = ("good", 0.9, 9), ("weak", 0.5, 9), None
    rows = spark.createDataFrame([(1, good, weak, weak), (2, weak, good, weak), (3, weak, ("v", 0.9, 2), weak), (4, weak, none, none), (5, none, ("v", 0.9, 2), none), (6, none, none, none)], f"id int, paddle {kind}, vision {kind}, easy {kind}")
    got = {r["id"]: r["c"] and r["c"]["text"] for r in rows.select("id", T.choose_ocr().alias("c")).collect()}
    assert got == {1: "good", 2: "good", 3: "weak", 4: "weak", 5: "v", 6: None}


def test_scans_are_appended_and_reports_written(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1)], "scan_id string, version int")
    for _ in range(2):
        T.append_scans(rows, str(tmp_path / "scans"))
    assert spark.read.parquet(str(tmp_path / "scans")).count() == 2
    T.write_reports(spark.createDataFrame([("s", [("name", 0.5)])], "scan_id string, fields array<struct<n:string,c:double>>"), str(tmp_path / "reports"))
    assert json.loads(spark.read.text(str(tmp_path / "reports")).first()[0]) == {"scan_id": "s", "fields": [{"n": "name", "c": 0.5}]}


def test_qr_payloads(spark):
    xml = b'<Q uid="1"/>'
    raw = zlib.compressobj(wbits=-15)
    rows = [(1, xml), (2, zlib.compress(xml)), (3, raw.compress(xml) + raw.flush()), (4, b"\x00\x01"), (5, None), (6, b"")]
    got = {r["id"]: r["x"] for r in spark.createDataFrame(rows, "id int, p binary").select("id", T.qr_text("p").alias("x")).collect()}
    assert got == {1: xml.decode(), 2: xml.decode(), 3: xml.decode(), 4: None, 5: None, 6: None}


def test_stream(spark, tmp_path):
    schema = "doc_id long, text string"
    rows = [(1, "mail a.b@example.com"), (2, None), (3, "nothing")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = scan_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = append_stream(stream.withColumn("n", F.size("fields")).drop("fields"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert sorted((r["doc_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 0), (3, 0)]


def test_column_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    kind = lambda *a: one(classify.combine(*map(F.lit, a)))["type"]
    assert [kind("pan", 0.6, "aadhaar", 0.9), kind("pan", 0.5, "aadhaar", 0.9), kind("pan", 0.5, "aadhaar", 0.2), kind("unknown", 0.0, "aadhaar", 0.0)] == ["pan", "aadhaar", "pan", "aadhaar"]
    old, new = (F.create_map(*[F.lit(x) for x in m]) for m in (("a", "allow"), ("a", "redact", "b", "mask")))
    assert one(policy.merge_decisions(old, new)) == {"a": "allow", "b": "mask"}
    assert [one(js_round(F.lit(x))) for x in (0.5, 1.4, -0.5)] == [1, 1, 0]
    fields = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(d).alias("decision")) for v, d in (("abcde", "mask"), ("x@y.z", "redact"), ("keep", "allow"))])
    assert one(redact.redact_text(F.lit("abcde x@y.z keep"), fields)) == "abcd**** [REDACTED] keep"


def test_rules_of_a_user(spark):
    """The default rules as a DataFrame give what the defaults give; literal forms are the fixed ones."""
    assert all(rules.literal_form(p) == t for p, t in rules.TEMPLATES.items())
    rows = spark.createDataFrame([(1, "pan", "PAN ABCDE1234F Name: ASHA RAO DOB: 01/02/1990"), (2, "voter_id", "Card ABC1234567")], "doc_id long, document_type string, text string")
    plain, own = (sorted(map(tuple, detect.extract_fields(rows, rules=r).select("doc_id", "field_name", "value", "method").collect())) for r in (None, rules.field_rules(spark)))
    assert plain == own and (1, "pan_number", "ABCDE1234F", "regex_fuzzy") in own
    assert policy.with_necessity(rows.limit(0).selectExpr("doc_id", "document_type", "'x' AS field_name", "'y' AS context"), rules.field_rules(spark)).columns[-1] == "required"
