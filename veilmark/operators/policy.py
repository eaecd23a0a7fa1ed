"""Necessity of fields for a purpose, decisions, exposure scores and explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CONTEXTS, default_rules, necessity, rule_rows
from ..functions.scalars import once, percent


def with_necessity(fields: DataFrame, rules: DataFrame | list[tuple] | None = None) -> DataFrame:
    """``fields`` with ``required``; the rule table (150 rows, or five for each rule of a user) is broadcast. Unknown fields are not required."""
    table = F.broadcast(necessity(fields.sparkSession, rules))
    return fields.join(table, ["document_type", "field_name", "context"], "left").withColumn("required", F.coalesce("required", F.lit(False)))


def requirements(rules: DataFrame | list[tuple] | None = None) -> Column:
    """Map from document type and field to the contexts that require the field, as a literal for ``judged``."""
    pairs = [(f"{r[0]}\x1f{r[1]}", r[8]) for r in (default_rules() if rules is None else rule_rows(rules))]
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), F.array(*[F.lit(c) for c in v]).cast("array<string>").alias("v"))
    return F.map_from_entries(F.array(*[entry(k, v) for k, v in dict(pairs).items()]))


def _with(f: Column, names: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*[f[c].alias(c) for c in names], *[v.alias(k) for k, v in more.items()])


#: Columns of a field as detected, as judged and as decided.
DETECTED = ("rule_pos", "field_name", "weight", "always_redact", "value", "confidence", "method", "word_start", "word_count")
JUDGED = (*DETECTED, "required", "decision")
DECIDED = (*JUDGED, "submitted", "applied")


def judged(fields: Column, document_type: Column, context: Column, rules: DataFrame | list[tuple] | None = None) -> Column:
    """``fields`` (an array, see ``detect.with_fields``) with ``required`` and the default ``decision``; unknown fields are not required."""

    def judge(f: Column, table: Column) -> Column:
        needed = F.coalesce(F.array_contains(F.try_element_at(table, F.concat(document_type, F.lit("\x1f"), f["field_name"])), context), F.lit(False))
        return once(needed, lambda r: _with(f, DETECTED, required=r, decision=F.when(f["always_redact"], "redact").when(r, "allow").otherwise("redact")))

    return once(requirements(rules), lambda table: F.transform(fields, lambda f: judge(f, table)))


def judged_by(fields: Column, rules: Column, context: Column) -> Column:
    """As ``judged``, by the array of the document's own rules (see ``detect.with_fields_of_rules``)."""

    def judge(f: Column) -> Column:
        needed = F.exists(F.coalesce(rules, F.array()), lambda r: (r["field_name"] == f["field_name"]) & F.coalesce(F.array_contains(r["required_in"], context), F.lit(False)))
        return once(needed, lambda r: _with(f, DETECTED, required=r, decision=F.when(f["always_redact"], "redact").when(r, "allow").otherwise("redact")))

    return F.transform(fields, judge)


def decided(fields: Column, submitted: Column) -> Column:
    """Judged ``fields`` with the decision that ``submitted`` (a map by field) has for each, and the one applied: a missing one allows, always_redact redacts."""

    def decide(f: Column) -> Column:
        return once(F.try_element_at(submitted, f["field_name"]), lambda d: _with(f, JUDGED, submitted=d, applied=F.when(f["always_redact"], "redact").otherwise(F.coalesce(d, F.lit("allow")))))

    return F.transform(fields, decide)


def exposure_of(fields: Column, where: Callable[[Column], Column] | None = None) -> Column:
    """Exposure score of judged ``fields``, or of those that fit: 10 points a weight for what is not needed, 2 for what is, over 10 a weight; 0 without any."""
    counted = fields if where is None else F.filter(fields, where)
    points = lambda f: F.when(f["always_redact"] | ~f["required"], f["weight"] * 10).otherwise(f["weight"] * 2)
    sums = F.aggregate(counted, F.struct(F.lit(0).alias("total"), F.lit(0).alias("most")), lambda s, f: F.struct((s["total"] + points(f)).alias("total"), (s["most"] + f["weight"] * 10).alias("most")))
    return once(sums, lambda s: F.when(s["most"] > 0, F.round(F.least(100.0 * s["total"] / s["most"], F.lit(100.0)), 1)).otherwise(0.0))


def exposed(f: Column) -> Column:
    """Whether a decided field stays visible: submitted as ``allow`` and not always redacted; a missing decision is not exposed."""
    return (F.coalesce(f["submitted"], F.lit("")) == "allow") & ~f["always_redact"]


def projected(allow_aware: bool, field: Column) -> Column:
    """Exposure as projected before redaction, not normalised: the part of one judged field."""
    needed = F.when(field["required"], field["weight"] * 2).otherwise(0)
    return F.when(field["decision"] == "allow", F.when(field["required"], field["weight"] * 2).otherwise(field["weight"] * 10)).otherwise(needed) if allow_aware else needed


def reduction(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.floor((before - after) / before * 100 + 0.5)).otherwise(0).cast("long")


def merge_decisions(old: Column, new: Column) -> Column:
    """Map of decisions in which the user's earlier choices win."""
    return F.map_zip_with(new, old, lambda _, a, b: F.coalesce(b, a))


def explanation(field: Column | None = None, document_type: Column | None = None) -> Column:
    """A sentence on how a field was found, of the row or of ``field`` (the wording is a fixed value)."""
    own = F.col if field is None else field.getItem
    name, value, conf, method = own("field_name"), own("value"), own("confidence"), own("method")
    kind = F.col("document_type") if document_type is None else document_type
    entity = F.when(name.isin("name", "father_name", "father_husband_name", "father_spouse_name"), "personal name (PER entity)").when(name.isin("address", "place_of_birth"), "location entity (LOC)").otherwise("named entity")
    text = F.lit
    return (
        F.when(method == "qr", F.concat(name, text(" extracted directly from the Aadhaar QR code with high confidence. The QR contains digitally signed resident data.")))
        .when(method == "mrz", F.concat(name, text(" decoded from the Machine Readable Zone (MRZ) at the bottom of the passport. MRZ lines encode the complete identity in a standardised format.")))
        .when(method == "regex_fuzzy", F.concat(name, text(" detected because the extracted text '"), F.left(value, F.lit(30)), F.when(F.length(value) > 30, "...").otherwise(""), text("' matches the "), kind, text(" identifier pattern (confidence: "), percent(conf), text("). "), F.when(conf > 0.92, "Exact match.").otherwise("Approximate match — verify if incorrect.")))
        .when(method == "ner", F.concat(name, text(" detected as a "), entity, text(" by the NER model near the keyword anchor. Confidence: "), percent(conf), text(".")))
        .when(method == "image", F.concat(name, text(" detected as a visual element (QR code / signature / photo region) in the document image. Always flagged regardless of context.")))
        .otherwise(F.concat(name, text(" detected in document.")))
    )


def split_contexts(requests: DataFrame, context_col: str = "context") -> tuple[DataFrame, DataFrame]:
    """Requests with a supported context, and the others (a null context is none)."""
    known = F.coalesce(F.col(context_col).isin(CONTEXTS), F.lit(False))
    return requests.where(known), requests.where(~known)


def field_response(fields: DataFrame, box_col: str = "bbox") -> DataFrame:
    """``fields`` as they are returned: confidence to three digits, the unit box where there is none, no metadata."""
    unit = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    return fields.withColumns({"confidence": F.round("confidence", 3), box_col: F.coalesce(box_col, unit)}).drop("metadata")
