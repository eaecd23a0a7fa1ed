"""Registered queries over the documents and the identity cards derived from ``customer``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scalars import confidence_label, email_local_part, first_match, lookup, mask, mask_display, once, risk_label, scan_key, words
from ..operators import classify, detect, entities, fuzzy, geometry, history, policy
from ..sources import recognised as R
from ..sources import tables as T
from ..sources.store import ScanStore

Query = Callable[[SparkSession, str], DataFrame]
PAGE = (800, 1200)
#: Buckets of the stored scans: at least, and cards of one, since a bucket is sorted and written by one task.
LEAST_BUCKETS, CARDS_A_BUCKET = 8, 50_000


def _detect(field: str, pattern: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = T.texts(spark, sf_dir)
        found = F.filter(F.array(F.struct(first_match(F.col("text"), pattern).alias("value"))), lambda x: x["value"].isNotNull())
        return rows.select("src", "doc_id", F.inline(found))

    query.__name__ = f"detect_{field}"
    return query


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.universal_scan(T.texts(spark, sf_dir))


def universal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scanned(spark, sf_dir).select("src", "doc_id", F.inline("fields"))
    return rows.select("src", "doc_id", "field_name", "value", F.col("weight").cast("long").alias("weight"), "confidence")


def scan_text_pei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No field is needed for any purpose here, so the score is 0 or 100."""
    n = F.size("fields").cast("long")
    return _scanned(spark, sf_dir).select("src", "doc_id", n.alias("n_fields"), F.when(n > 0, 100.0).otherwise(0.0).alias("pei_before"))


def scan_text_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select("src", "doc_id", F.md5(detect.highlight(F.coalesce("text", F.lit("")), F.col("fields"))).alias("highlight_md5"))


def docs_with_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).where(F.size("fields") > 0).select("src", "doc_id")


def docs_without_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).where(F.size("fields") == 0).select("src", "doc_id")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(T.id_cards(spark, sf_dir))


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.id_cards(spark, sf_dir).select("doc_id", *[s.alias(f"score_{k}") for k, s in classify.keyword_scores(F.col("text")).items()])


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "true_type", "document_type", "type_confidence")


def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    return rows.groupBy("document_type").agg(F.count("*").alias("n"), F.avg((F.col("document_type") == F.col("true_type")).cast("double")).alias("accuracy"))


def type_context_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).rollup("document_type", "context").agg(F.count("*").alias("n"))


def mrz_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.id_cards(spark, sf_dir).select("doc_id", detect.parse_mrz(F.col("text")).alias("m"))
    return rows.select("doc_id", F.inline(F.filter(F.array("m"), lambda m: m.isNotNull())))


def anchored_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers glued to their label, which only the anchored search finds."""
    glued = F.replace("text", F.lit("Number "), F.lit("Number"))
    rows = T.id_cards(spark, sf_dir).where("true_type = 'pan'").select("doc_id", glued.alias("text"))
    return rows.select("doc_id", first_match(F.col("text"), rules.PAN).alias("exact"), detect.anchored_match(F.col("text"), rules.PAN, ["permanent account number", "pan", "income tax"]).alias("anchored"))


def keyword_anchor_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.id_cards(spark, sf_dir).select("doc_id", detect.anchored_words(F.col("text"), "name", ["name", "नाम"]).alias("name"))


def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the words of all documents and cards."""
    rows = fuzzy.window_candidates(T.texts(spark, sf_dir).withColumn("key", F.struct("src", "doc_id")), "key")
    return rows.select("key.src", "key.doc_id", F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"), "candidate")


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate matches of the Aadhaar, PAN and EPIC templates in all texts and in literal fixtures."""
    fixtures = spark.sql("SELECT * FROM VALUES (-1L, '00000000000'), (-2L, '0000000000000'), (-3L, 'AAA0-97'), (-4L, 'ABCDE1234F'), (-5L, CAST(NULL AS STRING)) AS t(doc_id, text)")
    rows = T.texts(spark, sf_dir).unionByName(fixtures.withColumn("src", F.lit("literal")))
    tried = (("aadhaar", rules.AADHAAR, 85.0), ("pan", rules.PAN, 88.0), ("epic", rules.EPIC, 80.0))
    near = lambda tokens: F.array(*[F.struct(F.lit(n).alias("field_name"), fuzzy.best_window(tokens, F.lit(rules.TEMPLATES[p]), F.lit(t)).alias("best")) for n, p, t in tried])
    found = F.filter(once(words(F.coalesce("text", F.lit(""))), near), lambda x: x["best"].isNotNull())
    return rows.select("src", "doc_id", F.inline(found)).select("src", "doc_id", "field_name", "best.value", F.round("best.confidence", 9).alias("confidence"))


def _submitted(fields: Column) -> Column:
    """Submitted decisions by field, by arithmetic on the key; about a quarter of the fields has none."""
    k = lambda f: (F.col("doc_id") + F.length(f["field_name"])) % 4
    given = F.filter(fields, lambda f: k(f) < 3)
    return F.map_from_entries(F.transform(given, lambda f: F.struct(f["field_name"].alias("key"), F.when(k(f) == 0, "redact").when(k(f) == 1, "mask").otherwise("allow").alias("value"))))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards with the array of their fields, as detected."""
    return detect.with_fields(_classified(spark, sf_dir).drop("true_type"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards with the array of their fields, as judged for the card's context and as decided."""
    rows = _found(spark, sf_dir)
    judged = policy.judged(F.col("fields"), F.col("document_type"), F.col("context"))
    decided = once(judged, lambda fields: policy.decided(fields, _submitted(fields)))
    return rows.select(*[c for c in rows.columns if c != "fields"], F.explode(F.array(decided)).alias("fields"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.field_rows(_found(spark, sf_dir), "text", "type_confidence")


def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("doc_id", "document_type", "field_name", "value", "confidence", "method", "needs_review")


def extract_by_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the cards by rules that are a table, joined with the cards on their type, and whether the card's context requires each."""
    rows = detect.with_fields_of_rules(_classified(spark, sf_dir), rules.field_rules(spark))
    judged = policy.judged_by(F.col("fields"), F.col("rules"), F.col("context"))
    return rows.select("doc_id", F.inline(judged)).select("doc_id", "field_name", "value", "confidence", "method", "required")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.field_rows(_cards(spark, sf_dir), "text", "type_confidence")


def necessity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule table, with how many cards of a type come for a purpose that each row judges."""
    n = _classified(spark, sf_dir).groupBy("document_type", "context").agg(F.count("*").alias("n_cards"))
    rows = F.broadcast(rules.necessity(spark)).join(n, ["document_type", "context"], "left")
    return rows.select("document_type", "field_name", "context", "required", F.coalesce("n_cards", F.lit(0)).alias("n_cards"))


def necessity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", "field_name", "context", "required")


def excess_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda fits: F.size(F.filter("fields", fits)).cast("long")
    rows = _cards(spark, sf_dir).select("doc_id", n(lambda f: ~f["required"]).alias("n_excess"), n(lambda f: f["required"]).alias("n_required"), F.size("fields").cast("long").alias("n_fields"))
    return rows.where("n_fields > 0")


def default_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", "field_name", "decision")


def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", "field_name", "submitted", "applied")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir).select("doc_id", policy.exposure_of(F.col("fields")).alias("pei_before"), policy.exposure_of(F.col("fields"), policy.exposed).alias("pei_after"))


def pei_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", "pei_before")


def pei_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", "pei_after")


def pei_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (("pei_projected_required", False), ("pei_projected_decisions", True))
    total = lambda aware: F.aggregate("fields", F.lit(0), lambda s, f: s + policy.projected(aware, f))
    rows = _cards(spark, sf_dir).where(F.size("fields") > 0)
    return rows.select("doc_id", *[F.least(total(a), F.lit(100)).cast("double").alias(n) for n, a in names])


def pei_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", policy.reduction(F.col("pei_before"), F.col("pei_after")).alias("reduction"))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("doc_id", "field_name", policy.explanation().alias("explanation"))


def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("doc_id", "field_name", mask(F.col("value")).alias("masked"), mask_display(F.col("value")).alias("displayed"))


def needs_review_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).where(F.size("fields") > 0).select("doc_id", F.size(F.filter("fields", lambda f: f["confidence"] < 0.7)).cast("long").alias("n_review"))


def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("doc_id", "field_name", confidence_label(F.col("confidence")).alias("confidence_label"), risk_label(F.col("weight") * 10).alias("field_risk"))


def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = F.aggregate("fields", F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("w")), lambda s, f: F.struct((s["c"] + f["confidence"] * f["weight"]).alias("c"), (s["w"] + f["weight"]).alias("w")))
    rows = _found(spark, sf_dir).where(F.size("fields") > 0).select("doc_id", sums.alias("s"))
    return rows.select("doc_id", F.round(F.coalesce(F.try_divide("s.c", "s.w"), F.lit(0.0)), 9).alias("weighted_confidence"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with their boxes among the words of their card."""
    rows = _cards(spark, sf_dir)
    page = geometry.layout(words(F.coalesce("text", F.lit(""))))
    fields = geometry.boxed(F.col("fields"), page, F.col("document_type") != "unknown", policy.DECIDED, F.lit(PAGE[0]), F.lit(PAGE[1]))
    return rows.select("doc_id", "document_type", F.inline(fields))


def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("doc_id", "field_name", "bbox.x", "bbox.y", "bbox.width", "bbox.height")


def bbox_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in percent of the page; documents of unknown type have none."""
    scaled = geometry.normalise(F.col("bbox"), F.lit(PAGE[0]), F.lit(PAGE[1]))
    return _boxes(spark, sf_dir).select("doc_id", "field_name", F.when(F.col("document_type") != "unknown", scaled).alias("b")).select("doc_id", "field_name", "b.*")


def drawable_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).where(geometry.drawable(F.col("bbox"))).select("doc_id", "field_name")


def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the submitted decisions paint; a field without one stays, a signature never does."""
    corners = geometry.pad_clamp(F.col("bbox"), F.lit(PAGE[0]), F.lit(PAGE[1]))
    rows = _boxes(spark, sf_dir).select("doc_id", "field_name", geometry.painted(corners, F.col("applied")).alias("p"))
    return rows.where("p is not null").select("doc_id", "field_name", "p.*")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every third scan, scores that are null, zero or positive."""
    rows = classify.classify(T.id_cards(spark, sf_dir)).select("doc_id", "document_type", "context", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("version"))
    k = F.col("doc_id")
    return rows.select(
        F.concat(F.lit("scan-"), k).alias("scan_id"), F.concat(F.lit("2024-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit("T00:00:00+00:00")).alias("timestamp"), F.concat(F.lit("File_"), k, F.lit(".png")).alias("filename"), "document_type", F.col("context").alias("declared_context"),
        (k % 101).cast("double").alias("pei_before"), F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, 0.0).otherwise((k % 21).cast("double")).alias("pei_after"), (k % 4).cast("long").alias("needs_review_count"), F.col("version").cast("long").alias("version"),
    )


def latest_scan_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(_scans(spark, sf_dir))


def scan_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest_first(latest_scan_version(spark, sf_dir)).select("scan_id", "timestamp", "filename", "document_type", "declared_context", "pei_before", "pei_after", "needs_review_count")


def scan_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_scan_version(spark, sf_dir).where("scan_id = 'scan-42'")


def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.search(latest_scan_version(spark, sf_dir), "E_12").select("scan_id", "filename", "document_type")


def risk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.in_risk(latest_scan_version(spark, sf_dir), "high").select("scan_id", "pei_before")


def scan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_scan_version(spark, sf_dir).select("scan_id", lookup(F.col("document_type"), rules.TYPE_LABELS).alias("type_label"), risk_label(F.col("pei_before")).alias("risk"))


def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.totals(latest_scan_version(spark, sf_dir))
    return rows.select("n_scans", F.round("avg_before", 9).alias("avg_before"), F.round("avg_after", 9).alias("avg_after"), "reduction")


def top_exposed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.top_exposed(_judged(spark, sf_dir))


def recent_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest_first(latest_scan_version(spark, sf_dir), 10).select("scan_id", "timestamp")


def scan_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = latest_scan_version(spark, sf_dir).withColumn("doc_id", F.substring("scan_id", 6, 20).cast("long"))
    counts = _found(spark, sf_dir).select("doc_id", F.size("fields").cast("long").alias("n_fields"))
    rows = history.timeline(scans.join(counts, "doc_id", "left"), lookup(F.col("document_type"), rules.DOCUMENT_LABELS), F.coalesce("n_fields", F.lit(0)))
    return rows.select("scan_id", "timestamp", F.col("step").cast("long").alias("step"), "event")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    scans = _cards(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("scan-"), k).alias("scan_id"), F.concat(F.lit("2024-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit("T00:00:00+00:00")).alias("timestamp"), F.concat(F.lit("File_"), k, F.lit(".png")).alias("filename"),
        "document_type", F.col("type_confidence").alias("document_type_confidence"), F.col("context").alias("declared_context"), F.when(k % 3 == 0, F.concat(F.lit("redacted/"), k, F.lit(".png"))).alias("redacted_file_path"),
        policy.exposure_of(F.col("fields")).alias("pei_before"), policy.exposure_of(F.col("fields"), policy.exposed).alias("pei_after"), "fields",
    )
    return history.audit_report(scans, ["doc_id"])


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested reports, their fields and notes as JSON."""
    got = _reports(spark, sf_dir)
    return got.select(
        *[c for c in got.columns if c not in ("report_json", "fields_detected", "compliance_notes")], F.to_json("fields_detected").alias("fields_detected"), F.to_json("compliance_notes").alias("compliance_notes"), F.array_join(F.json_object_keys("report_json"), ",").alias("report_keys"),
    )


def audit_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with a report; every fifth has none yet, every seventh an empty one."""
    k = F.col("doc_id")
    rows = _classified(spark, sf_dir).select(k, F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, "").otherwise(F.concat(F.lit('{"scan_id":"scan-'), k, F.lit('"}'))).alias("report_json"))
    return history.with_audit(rows).select("doc_id", F.get_json_object("report_json", "$.scan_id").alias("scan_id"))


def context_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a context that is not supported (every ninth has one in capitals, every eleventh none)."""
    k = F.col("doc_id")
    rows = T.id_cards(spark, sf_dir).select(k, F.when(k % 9 == 0, F.upper("context")).when(k % 11 == 0, F.lit(None)).otherwise(F.col("context")).alias("context"))
    good, bad = policy.split_contexts(rows)
    return good.select("doc_id", "context", F.lit(True).alias("accepted")).unionByName(bad.select("doc_id", "context", F.lit(False).alias("accepted")))


def field_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields as they are returned: every second one has lost its box."""
    rows = _boxes(spark, sf_dir).withColumn("confidence", F.col("confidence") / 3)
    rows = policy.field_response(rows.withColumn("bbox", F.when((F.col("doc_id") + F.length("field_name")) % 2 == 0, F.col("bbox"))))
    return rows.select("doc_id", "field_name", "confidence", "bbox.x", "bbox.y", "bbox.width", "bbox.height")


def entity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity groups, the fields that they may fill, and how many of the cards' entities may fill each."""
    fields = F.create_map(*[x for g, own in rules.ENTITY_FIELDS.items() for x in (F.lit(g), F.array(*[F.lit(f) for f in own]))])
    found = T.id_cards(spark, sf_dir).select(F.inline(_entities())).select("entity_group", F.explode(fields[F.col("entity_group")]).alias("field_name"))
    return found.groupBy("entity_group", "field_name").agg(F.count("*").alias("n"))


def _entities() -> Column:
    """What a model might have found in a card: two persons, one of them an office, and a place, each where its words stand."""
    entity = lambda g, word, score: F.struct(F.lit(g).alias("entity_group"), word.alias("word"), score.cast("double").alias("score"), (F.instr("text", word) - 1).alias("start"))
    name = F.regexp_substr("text", F.lit("(ASHA|VIJAY|MEERA) (RAO|PATEL|KHAN|DAS)"))
    father = F.regexp_substr("text", F.lit("RAVI (RAO|PATEL|KHAN|DAS)"))
    office = F.regexp_substr("text", F.lit("Government of India|INCOME TAX DEPARTMENT|ELECTION COMMISSION OF INDIA"))
    place = F.regexp_substr("text", F.lit("Rampur|Pune|PUNE"))
    found = F.array(entity("PER", office, F.lit(0.99)), entity("PER", name, 0.5 + (F.col("doc_id") % 5) / 10), entity("PER", father, F.lit(0.6)), entity("LOC", place, F.lit(0.8)))
    return F.filter(found, lambda e: e["word"].isNotNull())


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best entity of each card for a name, a father's name and an address."""
    rows = T.id_cards(spark, sf_dir).select("doc_id", "text", _entities().alias("entities"))
    tries = [("name", ["name", "नाम"]), ("father_name", ["father", "father's name"]), ("address", ["address", "pin"])]
    best = F.array(*[F.struct(F.lit(f).alias("field_name"), entities.best_entity(F.col("entities"), F.col("text"), f, a).alias("best")) for f, a in tries])
    return rows.select("doc_id", F.inline(best)).where("best is not null").select("doc_id", "field_name", "best.value", F.round("best.confidence", 9).alias("confidence"))


def extract_with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of a user's two rules, of which one is filled by a model's entities."""
    own = [("voter_id", "name", 5, "ner", None, 0, ["elector's name", "name"], False, ["kyc_onboarding"]), ("voter_id", "card", 9, "regex_fuzzy", r"\b[A-Z]{3}\d{7}\b", 80, ["card"], False, ["kyc_onboarding"])]
    rows = _classified(spark, sf_dir).where("document_type = 'voter_id'").select("doc_id", "document_type", "context", "text", _entities().alias("entities"))
    found = policy.with_necessity(detect.extract_fields(rows, rules=own, entities_col="entities"), own)
    return found.select("doc_id", "field_name", "value", F.round("confidence", 9).alias("confidence"), "method", "required")


def unknown_with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the cards, all taken as texts of unknown type: universal patterns, then a name and an address among a model's entities.

    On every third card the model has named a value that a pattern finds too, which does not count twice."""
    again = F.struct(F.lit("LOC").alias("entity_group"), F.upper(F.regexp_substr("text", F.lit(rules.DATE))).alias("word"), F.lit(0.9).alias("score"), F.lit(0).alias("start"))
    model = F.when(F.col("doc_id") % 3 == 0, F.concat(_entities(), F.filter(F.array(again), lambda e: e["word"].isNotNull()))).otherwise(_entities())
    rows = T.id_cards(spark, sf_dir).select("doc_id", "text", model.alias("entities"))
    found = detect.universal_scan(rows, entities_col="entities").select("doc_id", F.inline("fields"))
    return found.select("doc_id", "field_name", "value", F.col("weight").cast("long").alias("weight"), F.round("confidence", 9).alias("confidence"), "method")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of contexts and methods."""
    rows = _fields(spark, sf_dir)
    return rows.select("doc_id", "field_name", lookup(F.col("context"), rules.CONTEXT_LABELS).alias("context_label"), lookup(F.col("method"), rules.METHOD_LABELS).alias("method_label"))


def email_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_email(spark, sf_dir).select("src", "doc_id", email_local_part(F.col("value")).alias("name"))


def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect("email", rules.EMAIL)(spark, sf_dir)


def scan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.id_cards(spark, sf_dir).select("doc_id", scan_key(F.col("doc_id"), F.col("text"), F.col("context")).alias("scan_key"))


def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of each card's recognised words, 0 without any, and whether the result is good enough."""
    rows = geometry.layout_words(T.id_cards(spark, sf_dir)).withColumn("confidence", 0.5 + ((F.col("doc_id") + F.col("pos")) % 10) / 20)
    means = rows.where("doc_id % 13 <> 0").groupBy("doc_id").agg(F.avg("confidence").alias("c"), F.count("*").alias("n"))
    mean = F.coalesce("c", F.lit(0.0))
    return T.id_cards(spark, sf_dir).select("doc_id").join(means, "doc_id", "left").select("doc_id", F.round(mean, 9).alias("mean_confidence"), ((mean >= 0.72) & (F.coalesce("n", F.lit(0)) >= 5)).alias("good"))


def classify_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of all cards and documents by a table of keywords, the default ones and a type for each four houses of the customers, and the default patterns."""
    houses = T.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("house_"), F.floor(F.col("c_custkey") / 4)).alias("document_type"), (F.col("c_custkey") + 100).cast("int").alias("type_pos"), F.concat(F.lit("House "), "c_custkey", F.lit(" ")).alias("keyword")
    )
    keywords = classify.keyword_table(spark).unionByName(houses)
    rows = classify.classify_by(T.texts(spark, sf_dir), keywords, {t: p for t, (_, p) in rules.KEYWORDS.items()})
    return rows.select("src", "doc_id", "document_type", F.round("type_confidence", 9).alias("type_confidence"))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards with stored output of three engines as JSON, made from their words: one of lines (weak on two cards of three), one of blocks, paragraphs and words of symbols (on some cards without enough words), one of triples (absent on every fifth)."""
    rows = T.id_cards(spark, sf_dir).select("doc_id", F.transform(words(F.col("text")), lambda w, i: F.struct(i.alias("i"), w.alias("w"))).alias("ws"))
    line = lambda x: F.format_string(
        "[[[%d.6,3],[%d,3.4],[%d,15],[%d,14.9]],[%s,%s]]", x["i"] * 10, x["i"] * 10 + 9, x["i"] * 10 + 8, x["i"] * 10, once(F.to_json(F.array(x["w"])), lambda j: j.substr(F.lit(2), F.length(j) - 2)),
        F.when(F.col("doc_id") % 3 == 0, "0.9").otherwise("0.6"),
    )
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    word = lambda x: F.struct(
        F.transform(F.split(x["w"], ""), lambda s: F.struct(s.alias("text"))).alias("symbols"), ((x["i"] % 10) / 10).alias("confidence"),
        F.struct(F.array(corner(x["i"] * 8, 2), corner(x["i"] * 8 + 7, 12)).alias("vertices")).alias("bounding_box"),
    )
    few = F.when(F.col("doc_id") % 4 == 0, F.slice("ws", 1, 3)).otherwise(F.col("ws"))
    paragraphs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda p: F.struct(F.transform(F.filter(few, lambda x: F.floor(x["i"] / 4) == p), word).alias("words")))
    last = F.struct(F.array(F.struct(F.transform(F.filter(few, lambda x: x["i"] >= 12), word).alias("words"))).alias("paragraphs"))
    tree = F.struct(F.array(F.struct(F.array(F.struct(paragraphs.alias("paragraphs")), last).alias("blocks"))).alias("pages"))
    triple = lambda x: F.regexp_replace(line(x), r"\],\[(\".*\",0\.\d)\]\]$", "],$1]")
    listed = lambda f: F.concat(F.lit("["), F.array_join(F.transform("ws", f), ","), F.lit("]"))
    return rows.select("doc_id", listed(line).alias("lines"), F.to_json(tree).alias("blocks"), F.when(F.col("doc_id") % 5 != 0, listed(triple)).alias("triples"))


def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of stored lines and blocks, with confidence and box."""
    rows = _outputs(spark, sf_dir).select("doc_id", F.explode(F.create_map(F.lit("lines"), R.page_of_lines(F.col("lines")), F.lit("blocks"), R.page_of_blocks(F.col("blocks")))).alias("kind", "page"))
    found = rows.select("doc_id", "kind", F.posexplode("page.words").alias("pos", "w"))
    return found.select("doc_id", "kind", F.col("pos").cast("long").alias("pos"), "w.text", "w.confidence", *[F.col(f"w.{c}").cast("long").alias(c) for c in ("x", "y", "width", "height")])


def recognition_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the first engine that is good enough; a costlier engine's stored output is looked up for the remainder only."""
    stored = lambda name: lambda image: F.when(image.isNotNull(), F.col(name))
    rows = R.recognise(_outputs(spark, sf_dir), "doc_id", stored("lines"), stored("blocks"), stored("triples"))
    return rows.select("doc_id", F.col("page_engine").cast("long").alias("engine"), F.col("page.n_words").cast("long").alias("n_words"), F.round("page.avg_confidence", 6).alias("avg_confidence"), F.md5("page.text").alias("text_md5"))


def stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read from JSON in which keys are missing and boxes have fractions."""
    k = F.col("doc_id")
    one = F.concat(F.lit('{"field_name":"name","field_value":"V'), k, F.lit('","confidence":0.'), 5 + k % 5, F.lit(',"bounding_box":{"x":'), k % 90, F.lit('.7,"y":2.2}}'))
    rows = T.id_cards(spark, sf_dir).select("doc_id", F.concat(F.lit("["), one, F.lit(',{"field_name":"dob"}]')).alias("stored"))
    got = T.fields_from_json(rows, "stored")
    return got.select("doc_id", "field_name", "field_value", F.col("sensitivity_weight").cast("long").alias("sensitivity_weight"), "detection_method", "confidence", F.col("bounding_box.x").cast("long").alias("x"), F.col("bounding_box.y").cast("long").alias("y"), F.col("bounding_box.width").cast("long").alias("width"), "needs_review", "required", "redaction_decision")


def _store(spark: SparkSession, sf_dir: str) -> ScanStore:
    """The cards as stored scans with fields and events; every tenth scan has not been stored. Two updates and a compaction have been made.

    Fields are detected by the insertion of the fields alone; what names scans only reads the cards' keys."""
    buckets = max(LEAST_BUCKETS, -(-T.table(spark, sf_dir, "customer").count() // CARDS_A_BUCKET))
    store = ScanStore(spark, f"veilmark_{uuid.uuid4().hex[:12]}", buckets).create()
    k = F.substring("scan_id", 6, 20).cast("long")
    key = F.concat(F.lit("scan-"), F.col("doc_id")).alias("scan_id")
    scans = _classified(spark, sf_dir).select(key, F.concat(F.lit("File_"), "doc_id", F.lit(".png")).alias("filename"), "document_type", F.col("context").alias("declared_context"), (F.col("doc_id") % 101).cast("double").alias("pei_before"))
    store.insert("scans", scans.where(k % 10 != 9))
    found = detect.field_rows(_found(spark, sf_dir).select(key, "fields"))
    store.insert("fields", found.withColumnsRenamed({"value": "field_value", "method": "detection_method", "weight": "sensitivity_weight"}))
    everyone = T.id_cards(spark, sf_dir).select(key)
    store.update(everyone.where(k % 2 == 0).select("scan_id", (k % 21).cast("double").alias("pei_after"), F.concat(F.lit("redacted/"), k).alias("redacted_file_path")))
    store.insert("audit_events", everyone.where(k % 2 == 0).withColumn("event_type", F.lit("redacted")))
    store.update(everyone.where(k % 3 == 0).select("scan_id", F.lit(0.0).alias("pei_after")))
    store.insert("audit_events", everyone.where(k % 3 == 0).withColumn("event_type", F.lit("cleared")))
    store.compact()
    return store


def stored_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows of the stored scans."""
    return _store(spark, sf_dir).current().select("scan_id", "filename", "pei_before", "pei_after", "redacted_file_path", "version")


def stored_scan_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fields and events of each stored scan, by equi-joins on its key."""
    store = _store(spark, sf_dir)
    fields = store.joined("fields").groupBy("scan_id", "document_type").agg(F.count("*").alias("n_fields"), F.sum("sensitivity_weight").alias("weight"))
    events = store.joined("audit_events").groupBy("scan_id").agg(F.count("*").alias("n_events"))
    return fields.join(events, "scan_id", "left").select("scan_id", "document_type", "n_fields", "weight", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def stored_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fields and events whose scan is not."""
    store = _store(spark, sf_dir)
    fields = store.orphans("fields").select("scan_id", F.lit("field").alias("kind"), F.col("field_name").alias("name"))
    return fields.unionByName(store.orphans("audit_events").select("scan_id", F.lit("event").alias("kind"), F.col("event_type").alias("name")))


def _qr_xml() -> Column:
    k = F.col("doc_id")
    return F.concat(F.lit('<PrintLetterBarcodeData uid="99'), k, F.lit('" name="QR NAME" dob="01/01/2001" house="H'), k, F.lit('" street="" vtc="Town" pc="411001"/>'))


def extract_with_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of Aadhaar cards of which every second has a readable code."""
    rows = _classified(spark, sf_dir).where("document_type = 'aadhaar'").withColumn("qr", F.when(F.col("doc_id") % 2 == 0, T.qr_text(_qr_xml().cast("binary"))))
    return detect.extract_fields(rows.select("doc_id", "document_type", "text", "qr"), qr_col="qr").select("doc_id", "field_name", "value", "confidence", "method")


def qr_xml_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address of a QR payload built for each customer."""
    k = F.col("c_custkey")
    xml = F.concat(F.lit('<PrintLetterBarcodeData uid="'), k, F.lit('" house="H'), k, F.lit('" street="" lm="Near Park" vtc="Town'), k % 7, F.lit('" dist="Pune" state="MH" pc="'), 411000 + k % 100, F.lit('"/>'))
    return T.table(spark, sf_dir, "customer").select(k.alias("doc_id"), xml.alias("xml")).select("doc_id", detect.qr_address(F.col("xml")).alias("address"))


def queries() -> dict[str, Query]:
    pairs = [("email", rules.EMAIL), ("phone", rules.PHONE), ("pan", rules.PAN), ("aadhaar", rules.AADHAAR), ("passport", rules.PASSPORT), ("date", rules.DATE)]
    typed = [("dl", rules.DL), ("epic", rules.EPIC), ("gender", rules.GENDER_A), ("blood_group", rules.BLOOD)]
    found = [_detect(n, p) for n, p in pairs + typed]
    found += [
        universal_scan, scan_text_pei, scan_text_highlight, docs_with_pii, docs_without_pii, keyword_scores, classify_documents, type_distribution, type_context_rollup, mrz_parse, anchored_regex, keyword_anchor_name, ngram_candidates,
        fuzzy_best, extract_fields, extract_by_rule_table, necessity_matrix, necessity_lookup, excess_fields, default_decisions, apply_decisions, pei_before, pei_after, pei_projected, pei_reduction, explanations, masked_values, needs_review_count, confidence_labels,
        weighted_confidence, bbox_union, bbox_normalise, redaction_boxes, latest_scan_version, scan_list, scan_by_id, history_search, risk_filter, scan_labels, dashboard_totals, top_exposed_fields, recent_scans, scan_timeline, audit_report, qr_xml_address,
        drawable_boxes, audit_present, context_validation, field_responses, entity_fields, entity_scores, extract_with_entities, unknown_with_entities, labels, email_names, scan_keys, word_confidence, stored_fields, extract_with_qr, stored_scans, stored_scan_fields, stored_orphans,
        classify_by_table, recognised_words, recognition_chain,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracles

    return oracles()
