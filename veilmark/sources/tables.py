"""Sources and sinks: tables, text and binary files, derived inputs, versioned scans, JSON reports."""

from __future__ import annotations

import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts of identity documents derived from ``customer``; {s} is the string type, {div} integer division.
ID_CARDS = """
SELECT k AS doc_id,
  CASE k % 6 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'pan' WHEN 2 THEN 'passport' WHEN 3 THEN 'driving_license' WHEN 4 THEN 'voter_id' ELSE 'unknown' END AS true_type,
  CASE (k {div} 6) % 5 WHEN 0 THEN 'age_verification' WHEN 1 THEN 'identity_verification' WHEN 2 THEN 'address_proof' WHEN 3 THEN 'kyc_onboarding' ELSE 'general_upload' END AS context,
  CASE k % 6
   WHEN 0 THEN concat('Government of India Unique Identification Authority Aadhaar Name: ', nm, ' DOB: ', dob, ' ', gen, ' Address: House ', k, ' Village Rampur Mobile 9', lpad(CAST(k % 1000000000 AS {s}), 9, '0'),
     ' ', CAST(2000 + k % 8000 AS {s}), ' ', lpad(CAST(k * 7 % 10000 AS {s}), 4, '0'), ' ', lpad(CAST(k * 13 % 10000 AS {s}), 4, '0'))
   WHEN 1 THEN concat('INCOME TAX DEPARTMENT Permanent Account Number ', chr(CAST(65 + k % 26 AS INT)), chr(CAST(65 + k * 7 % 26 AS INT)), 'XYZ', lpad(CAST(k % 10000 AS {s}), 4, '0'),
     chr(CAST(65 + k * 3 % 26 AS INT)), ' Name: ', nm, ' Father''s Name: ', nm2, ' Date of Birth: ', dob)
   WHEN 2 THEN concat('REPUBLIC OF INDIA PASSPORT No B1', lpad(CAST(k % 10000000 AS {s}), 7, '0'), ' Surname ', sn, ' Nationality IND Place of Birth PUNE ', rpad(concat('P<IND', sn, '<<', gn), 44, '<'), ' ',
     rpad(concat('A', CAST(10000000 + k AS {s}), '0IND', yy, mm, dd, '0', substr(gen, 1, 1), '3', substr(yy, 2, 1), mm, dd, '0'), 44, '<'))
   WHEN 3 THEN concat('DRIVING LICENCE TRANSPORT DEPT DL No MH', CAST(10 + k % 90 AS {s}), CAST(1000000 + k AS {s}), ' Name: ', nm, ' DOB: ', dob, ' Address: House ', k, ' Pune Blood Group O+x')
   WHEN 4 THEN concat('ELECTION COMMISSION OF INDIA Elector Photo Identity Card ABC', CAST(1000000 + k AS {s}), ' Name: ', nm, ' Father: ', nm2, ' Date of Birth: ', dob, ' ', gen, ' Address: House ', k, ' Pune')
   ELSE concat('Please write to user', k, '@example.com or call 8', lpad(CAST(k % 1000000000 AS {s}), 9, '0'), ' before ', dob)
  END AS text
FROM (SELECT k, concat(gn, ' ', sn) AS nm, concat('RAVI ', sn) AS nm2, sn, gn, yy, mm, dd, concat(dd, '/', mm, '/19', yy) AS dob, CASE k % 2 WHEN 0 THEN 'Male' ELSE 'Female' END AS gen
      FROM (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'RAO' WHEN 1 THEN 'PATEL' WHEN 2 THEN 'KHAN' ELSE 'DAS' END AS sn, CASE c_custkey % 3 WHEN 0 THEN 'ASHA' WHEN 1 THEN 'VIJAY' ELSE 'MEERA' END AS gn,
              CAST(50 + c_custkey % 49 AS {s}) AS yy, lpad(CAST(1 + c_custkey % 12 AS {s}), 2, '0') AS mm, lpad(CAST(1 + c_custkey % 28 AS {s}), 2, '0') AS dd FROM {customer}) a) b
"""


#: Rows of a task where each is much work: at most, and at least if there are more cores than tasks.
ROWS_A_TASK, LEAST_ROWS_A_TASK = 10_000, 500

#: Columns of the stored tables.
SCANS = (
    "scan_id string, timestamp string, filename string, document_type string, document_type_confidence double, declared_context string, original_file_path string, processable_image_path string, raw_text string, "
    "detected_fields_json string, pei_before double, pei_after double, redacted_file_path string, audit_report_json string, highlighted_text string, needs_review_count int, version long"
)
FIELDS = "scan_id string, field_name string, field_value string, detection_method string, confidence double, needs_review boolean, always_redact boolean, required boolean, redaction_decision string, sensitivity_weight int"
AUDIT_EVENTS = "scan_id string, event_type string, event_data string, timestamp string"
STORED = {"scans": SCANS, "fields": FIELDS, "audit_events": AUDIT_EVENTS}


_BOX = "struct<x:double,y:double,width:double,height:double>"
_STORED_FIELD = f"array<struct<field_name:string,field_value:string,sensitivity_weight:int,detection_method:string,confidence:double,bounding_box:{_BOX},needs_review:boolean,always_redact:boolean,explanation:string,required:boolean,redaction_decision:string,bounding_box_pct:{_BOX}>>"


def fields_from_json(rows: DataFrame, json_col: str) -> DataFrame:
    """One row per field of a stored list, with the defaults of what is missing; boxes in pixels are cut to whole ones."""
    others = [c for c in rows.columns if c != json_col]
    f = rows.select(*others, F.explode(F.from_json(json_col, _STORED_FIELD)).alias("f"))
    whole = F.struct(*[F.coalesce(F.col(f"f.bounding_box.{c}"), F.lit(0.0)).cast("int").alias(c) for c in ("x", "y", "width", "height")])
    percent = F.when(F.col("f.bounding_box_pct").isNotNull(), F.struct(*[F.coalesce(F.col(f"f.bounding_box_pct.{c}"), F.lit(0.0)).alias(c) for c in ("x", "y", "width", "height")]))
    default = lambda c, v: F.coalesce(F.col(f"f.{c}"), F.lit(v)).alias(c)
    return f.select(
        *others, F.col("f.field_name").alias("field_name"), default("field_value", ""), default("sensitivity_weight", 1), default("detection_method", "regex_fuzzy"), default("confidence", 0.0), whole.alias("bounding_box"),
        (F.coalesce(F.col("f.needs_review"), F.lit(False)) | (F.coalesce(F.col("f.confidence"), F.lit(0.0)) < 0.7)).alias("needs_review"), default("always_redact", False), default("explanation", ""), default("required", False),
        default("redaction_decision", "redact"), percent.alias("bounding_box_pct"),
    )


@F.pandas_udf(StringType())
def qr_text(payload: pd.Series) -> pd.Series:
    """XML of a code's payload: as it is, or inflated (raw or with a header); null if it is neither."""

    def text(raw: bytes | None) -> str | None:
        for read in (bytes, lambda x: zlib.decompress(x, -zlib.MAX_WBITS), zlib.decompress) if raw is not None else ():
            try:
                found = read(raw).decode()
                ElementTree.fromstring(found)
                return found
            except (zlib.error, UnicodeDecodeError, ElementTree.ParseError):
                continue
        return None

    return payload.map(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in as many tasks as their number asks for, whatever keys they have."""
    n = rows.count()
    tasks = max(-(-n // ROWS_A_TASK), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS_A_TASK)))
    return rows.repartition(max(tasks, 1))


def id_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, true_type, context, text.

    A customer takes a few bytes and its card a millisecond of work, so the customers are dealt out by their number: their file alone would
    be one task. The rows pass a generator, so that filters and projections above it do not repeat the expression of the text."""
    rows = spark.sql(ID_CARDS.format(s="STRING", div="DIV", customer="{customer}"), customer=_dealt(table(spark, sf_dir, "customer").select("c_custkey")))
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and identity cards: src, doc_id, text."""
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), "doc_id", "text")
    return docs.unionByName(id_cards(spark, sf_dir).select(F.lit("card").alias("src"), "doc_id", "text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: doc path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes, labelled by their folder; types beyond jpg, jpeg, png and pdf are left out."""
    rows = spark.read.format("binaryFile").load(path)
    kept = rows.where(F.lower("path").rlike(r"\.(jpe?g|png|pdf)$"))
    return kept.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def choose_ocr(paddle: str = "paddle", vision: str = "vision", easy: str = "easy"):
    """Which engine's result counts, from struct columns (text, avg_confidence, n_words)."""
    p, v, e = F.col(paddle), F.col(vision), F.col(easy)
    some = lambda x: F.coalesce(x["n_words"], F.lit(0)) > 0
    return F.when((p["avg_confidence"] >= 0.72) & (p["n_words"] >= 5), p).when(v["n_words"] >= 5, v).when(some(e), e).when(some(p), p).when(some(v), v)


def append_scans(scans: DataFrame, path: str) -> None:
    """Append versions of scans; readers take the latest (see ``operators.history.latest``)."""
    scans.write.mode("append").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)
