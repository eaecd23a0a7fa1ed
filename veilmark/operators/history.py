"""Scan history: latest versions, filters, dashboards and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mask, risk_label
from .policy import explanation, reduction


def latest(scans: DataFrame) -> DataFrame:
    """The row of each scan with the highest version; history is append-only."""
    newest = Window.partitionBy("scan_id").orderBy(F.desc("version"))
    return scans.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def search(scans: DataFrame, text: str) -> DataFrame:
    """Scans whose file name or type has ``text``, whatever the case; wildcards are plain characters."""
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return scans.where(has("filename") | has("document_type"))


def in_risk(scans: DataFrame, bucket: str) -> DataFrame:
    return scans.where(risk_label(F.coalesce("pei_before", F.lit(0.0))) == bucket)


def newest_first(scans: DataFrame, n: int | None = None) -> DataFrame:
    ordered = scans.orderBy(F.desc("timestamp"), "scan_id")
    return ordered if n is None else ordered.limit(n)


def _or_zero(*cols: str) -> Column:
    """The first that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in cols], F.lit(0.0))


def totals(scans: DataFrame) -> DataFrame:
    got = scans.agg(F.count("*").alias("n_scans"), F.coalesce(F.avg(_or_zero("pei_before")), F.lit(0.0)).alias("avg_before"), F.coalesce(F.avg(_or_zero("pei_after", "pei_before")), F.lit(0.0)).alias("avg_after"))
    return got.withColumn("reduction", reduction(F.col("avg_before"), F.col("avg_after")))


def top_exposed(fields: DataFrame, n: int = 8) -> DataFrame:
    return fields.where(~F.col("required")).groupBy("field_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field_name").limit(n)


def with_audit(scans: DataFrame, report_col: str = "report_json") -> DataFrame:
    """Scans that have a report; an empty one counts as none."""
    return scans.where(F.coalesce(F.col(report_col), F.lit("")) != "")


#: Texts of the compliance notes, by the report's keys; callers replace them by their own wording.
NOTES = {
    "dpdp_act": "Digital Personal Data Protection Act 2023, Section 6: personal data may be processed for a lawful purpose with consent only. Fields beyond the declared purpose are marked.",
    "gdpr_article_5": "GDPR Article 5(1)(c): personal data must be adequate, relevant and limited to what is necessary. Fields marked as excess go beyond the declared purpose.",
}


def audit_report(scans: DataFrame, keys: list[str], notes: dict[str, str] = NOTES) -> DataFrame:
    """One nested report per scan, also as JSON.

    ``scans`` has the keys, scan_id, timestamp, filename, document_type, document_type_confidence, declared_context, pei_before,
    pei_after, redacted_file_path and ``fields``, the array of decided fields in rule order. Scans without a field have an empty list."""

    def told(f: Column) -> Column:
        return F.struct(
            f["field_name"].alias("field_name"), mask(f["value"]).alias("detected_value_masked"), f["weight"].alias("sensitivity_weight"), f["method"].alias("detection_method"), F.round(f["confidence"], 2).alias("confidence"),
            (f["confidence"] < 0.7).alias("needs_review"), f["required"].alias("required"), f["applied"].alias("redaction_decision"), f["always_redact"].alias("always_redact"), explanation(f, F.col("document_type")).alias("explanation"),
        )

    got = scans.select(
        *keys, "scan_id", "timestamp", "filename", "document_type", F.round("document_type_confidence", 3).alias("document_type_confidence"), "declared_context", F.round("pei_before", 1).alias("pei_before"), F.round("pei_after", 1).alias("pei_after"),
        F.transform("fields", told).alias("fields_detected"), F.struct(*[F.lit(v).alias(k) for k, v in notes.items()]).alias("compliance_notes"), F.coalesce("redacted_file_path", F.lit("")).alias("redacted_file_path"),
    )
    return got.withColumn("report_json", F.to_json(F.struct(*[c for c in got.columns if c not in keys]), {"ignoreNullFields": "false"}))


def timeline(scans: DataFrame, type_label: Column, n_fields: Column) -> DataFrame:
    """Five events of each scan, in order (fixed texts)."""
    steps = [F.lit("document uploaded"), F.lit("ocr extraction completed"), F.concat(F.lit("classified as "), type_label), F.concat(n_fields.cast("string"), F.lit(" fields detected")), F.lit("redaction applied")]
    return scans.select("scan_id", "timestamp", F.posexplode(F.array(*steps)).alias("step", "event"))
