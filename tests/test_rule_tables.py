"""Rules as a table that is joined: the same fields as rules in the plan, any number of them, nothing on the driver."""

from pyspark.sql import functions as F

from veilmark.functions import rules
from veilmark.operators import classify, detect, policy
from veilmark.sources import tables as T


def fields(rows):
    return sorted((r["doc_id"], tuple(map(tuple, r["fields"]))) for r in rows.select("doc_id", "fields").collect())


def test_default_rules_as_a_table_give_what_the_plan_gives(spark, sf_dir):
    kind = "array<struct<entity_group:string,word:string,score:double,start:int>>"
    entity = F.array(F.struct(F.lit("PER").alias("entity_group"), F.regexp_substr("text", F.lit("(ASHA|VIJAY) [A-Z]+")).alias("word"), F.lit(0.9).alias("score"), F.lit(3).alias("start"))).cast(kind)
    rows = classify.classify(T.id_cards(spark, sf_dir)).where("doc_id < 60").withColumn("entities", F.when(F.col("doc_id") % 2 == 0, entity))
    rows = rows.withColumn("qr", F.when(F.col("doc_id") % 4 == 0, '<Q uid="12" name="QR NAME" house="H1" vtc="Town"/>'))
    table = rules.field_rules(spark)
    for more in ({}, {"entities_col": "entities", "qr_col": "qr"}):
        plan, joined = detect.with_fields(rows, **more), detect.with_fields_of_rules(rows, table, **more)
        assert fields(plan) == fields(joined)
    a = plan.withColumn("fields", policy.judged(F.col("fields"), F.col("document_type"), F.col("context")))
    b = joined.withColumn("fields", policy.judged_by(F.col("fields"), F.col("rules"), F.col("context")))
    assert fields(a) == fields(b)


def test_ten_thousand_rules(spark, monkeypatch):
    """Rules of a user, most for other types; the rule table never comes to the driver, and a plan does not grow with it."""
    monkeypatch.setattr(rules, "rule_rows", None)
    monkeypatch.setattr(detect, "rule_rows", None)
    own = spark.range(10_000).selectExpr(
        "cast(id AS int) AS rule_pos", "concat('type', id % 500) AS document_type", "concat('field', id) AS field_name", "cast(1 + id % 9 AS int) AS weight", "'regex_fuzzy' AS method", "concat('\\\\bK', id, '-\\\\d{3}\\\\b') AS pattern",
        "80 AS threshold", "array('key') AS anchors", "id % 2 = 0 AS always_redact", "array('kyc_onboarding') AS required_in",
    )
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('type', id) AS document_type", "concat('see K', id, '-123 and K', id + 500, '-456 and K', id + 1, '-789') AS text")
    docs = docs.unionByName(spark.createDataFrame([(900, "none", "mail a@b.org"), (901, None, None)], "doc_id long, document_type string, text string"))
    got = {r["doc_id"]: [(f["field_name"], f["value"]) for f in r["fields"]] for r in detect.with_fields_of_rules(docs, own, fuzzy=False).collect()}
    assert got == {i: [(f"field{i}", f"K{i}-123"), (f"field{i + 500}", f"K{i + 500}-456")] for i in range(200)} | {900: [("email", "a@b.org")], 901: []}
    monkeypatch.setattr(detect, "MAX_BROADCAST_BYTES", 0)
    again = detect.with_fields_of_rules(docs, own, fuzzy=False)
    assert {r["doc_id"]: len(r["fields"]) for r in again.collect()} == {i: len(f) for i, f in got.items()}


def test_no_rules(spark):
    docs = spark.createDataFrame([(1, "pan", "call 9876543210")], "doc_id long, document_type string, text string")
    found = detect.with_fields_of_rules(docs, rules.field_rules(spark).where("1 = 0")).first()
    assert [f["field_name"] for f in found["fields"]] == ["phone"] and found["rules"] is None
