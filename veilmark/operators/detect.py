"""Field detection: the universal scan of untyped texts and the cascade of typed documents.

A document's fields are an array in its row, found by one projection without joins, shuffles or Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.rules import NAME_BLACKLIST, SKIP_WORDS, UNIVERSAL, default_rules, literal_form, rule_rows
from ..functions.scalars import after_anchor, once, strip, words
from .fuzzy import best_window

#: A detected field; the words of an approximate match are known, else the last two are null.
FIELD = "struct<rule_pos:int,field_name:string,weight:int,always_redact:boolean,value:string,confidence:double,method:string,word_start:int,word_count:int>"
#: Fields that entities of a model fill in texts of unknown type, in order, and their weight (fixed values).
FREE_ENTITIES, FREE_WEIGHT = ("name", "address"), 5
#: A rule's outcome on a text: what an early step has settled, what a later one offers, and what an approximate match needs.
OUTCOME = "struct<rule_pos:int,field_name:string,weight:int,always_redact:boolean,early:struct<value:string,confidence:double,method:string>,later:struct<value:string,confidence:double,method:string>,template:string,threshold:double>"


def universal_fields(text: Column, entities: Column | None = None) -> Column:
    """Array of the fields found by the universal patterns and then by a model's entities, in order; a value counts once, whatever its case.

    A pattern gives its first value that is new, an entity field its best one if that is new."""
    from .entities import best_entity

    found = [F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0))), _candidate(i, name, w)) for i, (name, w, p) in enumerate(UNIVERSAL)]
    for i, name in enumerate(FREE_ENTITIES if entities is not None else (), len(UNIVERSAL)):
        best = F.filter(F.array(best_entity(entities, text, name, [])), lambda e: e.isNotNull())
        found.append(F.transform(best, _named(i, name)))

    def add(out: Column, own: Column) -> Column:
        fresh = F.filter(own, lambda x: ~F.exists(out, lambda y: F.lower(y["value"]) == F.lower(x["value"])))
        return F.concat(out, F.slice(fresh, F.lit(1), F.lit(1)))

    return F.aggregate(F.array(*found), F.array().cast(f"array<{FIELD}>"), add)


def _field(pos: int, name: str, weight: int, always: bool, value: Column, confidence: Column, method: Column) -> Column:
    nothing = F.lit(None).cast("int")
    return F.struct(
        F.lit(pos).alias("rule_pos"), F.lit(name).alias("field_name"), F.lit(weight).alias("weight"), F.lit(always).alias("always_redact"), value.alias("value"), confidence.cast("double").alias("confidence"), method.alias("method"),
        nothing.alias("word_start"), nothing.alias("word_count"),
    ).cast(FIELD)


def _candidate(i: int, name: str, weight: int):
    return lambda v: _field(i, name, weight, False, v, F.lit(0.85), F.lit("regex_fuzzy"))


def _named(i: int, name: str):
    return lambda e: _field(i, name, FREE_WEIGHT, False, e["value"], e["confidence"], F.lit("ner"))


def universal_scan(docs: DataFrame, text_col: str = "text", entities_col: str | None = None) -> DataFrame:
    """``docs`` with ``fields``. A narrow projection without shuffles or Python."""
    return docs.withColumn("fields", universal_fields(F.coalesce(F.col(text_col), F.lit("")), F.col(entities_col) if entities_col else None))


def highlight(text: Column, fields: Column) -> Column:
    """The text with every value, field by field, replaced by ``[name:value]``."""
    return F.aggregate(fields, text, lambda acc, f: F.replace(acc, f["value"], F.concat(F.lit("["), f["field_name"], F.lit(":"), f["value"], F.lit("]"))))


def parse_mrz(text: Column) -> Column:
    """Struct of the fields of a machine-readable zone in the text, or null. Case matters."""
    line = r"[A-Z0-9<]{44}"
    short = F.regexp_extract_all(text, F.lit(r"[A-Z0-9<]{40,44}"), F.lit(0))
    lines = lambda one, two: F.struct(one.alias("one"), two.alias("two"))
    halves = lambda pair: F.when(pair != "", lines(F.left(pair, F.lit(44)), F.right(pair, F.lit(44))))
    apart = once(short, lambda s: F.when(F.size(s) >= 2, lines(F.get(s, F.lit(0)), F.get(s, F.lit(1)))))
    found = F.coalesce(once(F.regexp_extract(text, rf"{line}\s*\n?\s*{line}", 0), halves), apart)
    return once(found, lambda p: _mrz_fields(p["one"], p["two"]))


def _mrz_fields(one: Column, two: Column) -> Column:
    names = F.split(F.substring(one, 6, 44), "<<")
    clean = lambda x: strip(F.replace(F.coalesce(x, F.lit("")), F.lit("<"), F.lit(" ")))

    def date(at: int) -> Column:
        raw = F.substring(two, at, 6)
        yy = F.substring(raw, 1, 2)
        whole = F.concat(F.substring(raw, 5, 2), F.lit("/"), F.substring(raw, 3, 2), F.lit("/"), F.when(yy.try_cast("int") > 40, "19").otherwise("20"), yy)
        return F.when(raw.rlike("^[0-9]{6}$"), whole).otherwise(raw)

    sex = F.substring(two, 21, 1)
    fields = F.struct(
        F.replace(F.substring(two, 1, 9), F.lit("<"), F.lit("")).alias("passport_number"), strip(F.concat_ws(" ", clean(F.get(names, F.lit(0))), clean(F.get(names, F.lit(1))))).alias("name"),
        F.substring(two, 11, 3).alias("nationality"), date(14).alias("dob"), F.when(sex == "M", "Male").when(sex == "F", "Female").otherwise(sex).alias("sex"), date(22).alias("date_of_expiry"),
        F.concat(one, F.lit("\n"), two).alias("mrz_lines"),
    )
    return F.when(one.startswith("P"), fields)


def blacklisted(value: Column) -> Column:
    """Whether more than three tenths of the distinct words are no name's."""
    listed = F.split(F.lit(" ".join(NAME_BLACKLIST)), " ")
    share = lambda distinct: (F.size(distinct) > 0) & (F.size(F.array_intersect(distinct, listed)) / F.greatest(F.size(distinct), F.lit(1)) > 0.3)
    return once(F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"\w+"), F.lit(0))), share)


def _list(anchors: list[str] | Column) -> Column:
    return anchors if isinstance(anchors, Column) else F.array(*[F.lit(a) for a in anchors])


def anchored_words(text: Column, field: str | Column, anchors: list[str] | Column) -> Column:
    """Up to five words after the first anchor that yields any, without label words."""
    value = lambda a: F.array_join(F.filter(F.slice(words(strip(after_anchor(text, a))), 1, 5), lambda w: ~F.lower(w).isin(SKIP_WORDS)), " ")
    personal = (field if isinstance(field, Column) else F.lit(field)).isin("name", "father_name")
    keep = lambda v: (F.coalesce(v, F.lit("")) != "") & (~personal | ~blacklisted(v))
    return F.get(F.filter(F.transform(_list(anchors), value), keep), F.lit(0))


def _first(text: Column, pattern: Column) -> Column:
    """First match, empty without one: ``regexp_substr`` would search twice where it stands in a branch or a lambda."""
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def anchored_match(text: Column, pattern: str | Column, anchors: list[str] | Column) -> Column:
    """First match of the pattern after the first anchor that has one behind it."""
    pattern = pattern if isinstance(pattern, Column) else F.lit("(?i)" + pattern)
    found = F.transform(_list(anchors), lambda a: _first(after_anchor(text, a), pattern))
    return F.get(F.filter(found, lambda v: v != ""), F.lit(0))


QR_FIELDS = {"aadhaar_number": "uid", "name": "name", "dob": "dob", "gender": "gender", "phone": "phone"}


def qr_address(xml: Column) -> Column:
    """Address of a QR payload: its parts without the empty ones."""
    return F.concat_ws(", ", *[F.nullif(F.xpath_string(xml, F.lit(f"/*/@{a}")), F.lit("")) for a in ("house", "street", "lm", "loc", "vtc", "dist", "state", "pc")])


MRZ_FIELDS = ("passport_number", "name", "dob", "date_of_expiry", "mrz_lines")


def _step(value: Column, confidence: Column | float, method: str) -> Column:
    """What a step offers, or null if it has no value. The value's expression stands in it once only."""
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    offered = F.transform(F.array(value), lambda v: F.when(v != "", F.struct(v.alias("value"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method"))))
    return F.get(offered, F.lit(0))


def _steps(own: list[Column], early: list[Column], later: list[Column], template: Column, threshold: Column) -> Column:
    """A rule's outcome; later steps are taken only where no early one has settled it."""
    return once(F.coalesce(*early), lambda e: F.struct(*own, e.alias("early"), F.when(e.isNull(), F.coalesce(*later)).alias("later"), template.alias("template"), threshold.alias("threshold")).cast(OUTCOME))


def _outcome(i: int, rule: tuple, text: Column, mrz: Column, qr: Column | None, entities: Column | None) -> Column:
    """What the steps of one rule find in a text. Patterns are literals, so each is compiled once."""
    from .entities import best_entity

    kind, field, weight, method, pattern, threshold, anchors, always, _ = rule
    nothing = F.lit(None).cast("struct<value:string,confidence:double,method:string>")
    early, later = [nothing], [nothing]
    if qr is not None and "qr_primary" in method and (field in QR_FIELDS or field == "address"):
        early.append(_step(qr_address(qr) if field == "address" else F.xpath_string(qr, F.lit(f"/*/@{QR_FIELDS[field]}")), 0.98, "qr"))
    if "mrz_primary" in method and field in MRZ_FIELDS:
        early.append(_step(mrz[field], 0.95, "mrz"))
    if pattern:
        early.append(_step(_first(text, F.lit("(?i)" + pattern)), 0.95, "regex_fuzzy"))
        later.append(_step(anchored_match(text, pattern, anchors), 0.82, "regex_fuzzy"))
    if "ner" in method:
        if entities is not None:
            best = best_entity(entities, text, field, anchors)
            later.append(_step(best["value"], best["confidence"], "ner"))
        later.append(_step(anchored_words(text, field, anchors), 0.55, "ner"))
    if method == "image" and field == "signature":
        later.append(_step(F.lit("SIGNATURE_REGION"), 0.6, "image"))
    own = [F.lit(i).alias("rule_pos"), F.lit(field).alias("field_name"), F.lit(weight).alias("weight"), F.lit(always).alias("always_redact")]
    return _steps(own, early, later, F.lit(literal_form(pattern) if pattern else None).cast("string"), F.lit(float(threshold)))


#: Outcomes of rule tables already written as columns, by application and rules: writing them takes longer than planning them.
_OUTCOMES: dict[tuple[str, str, bool, bool], Column] = {}


def _outcomes(application: str, rows: list[tuple], qr: bool, entities: bool) -> Column:
    """Array of the outcomes of the rules of a document's type; null for other types. Reads document_type, _text, _mrz, _qr and _entities."""
    key = (application, repr(rows), qr, entities)
    if key not in _OUTCOMES:
        out = F.lit(None).cast(f"array<{OUTCOME}>")
        for k in dict.fromkeys(r[0] for r in reversed(rows)):
            code = F.col("_qr") if qr and k == "aadhaar" else None
            found = F.array(*[_outcome(i, r, F.col("_text"), F.col("_mrz"), code, F.col("_entities") if entities else None) for i, r in enumerate(rows) if r[0] == k])
            out = F.when(F.col("document_type") == k, found).otherwise(out)
        if len(_OUTCOMES) > 8:
            _OUTCOMES.clear()
        _OUTCOMES[key] = out
    return _OUTCOMES[key]


def _settled(outcomes: Column, text: Column, fuzzy: bool) -> Column:
    """The fields that the outcomes of a document's rules come to; only rules that no early step has settled are matched approximately."""

    def settle(o: Column, tokens: Column) -> Column:
        unsettled = o["early"].isNull() & o["template"].isNotNull()
        near = F.when(unsettled, best_window(tokens, o["template"], o["threshold"])) if fuzzy else F.lit(None).cast("struct<value:string,confidence:double,word_start:int,word_count:int>")

        def field(n: Column) -> Column:
            won = F.coalesce(o["early"], _step(n["value"], n["confidence"], "regex_fuzzy"), o["later"])
            rule = [o[c].alias(c) for c in ("rule_pos", "field_name", "weight", "always_redact")]
            return once(won, lambda w: F.when(w.isNotNull(), F.struct(*rule, *[w[c].alias(c) for c in ("value", "confidence", "method")], n["word_start"].alias("word_start"), n["word_count"].alias("word_count")).cast(FIELD)))

        return once(near, field)

    return once(F.struct(outcomes.alias("rules"), words(text).alias("tokens")), lambda p: F.filter(F.transform(p["rules"], lambda o: settle(o, p["tokens"])), lambda f: f.isNotNull()))


def with_fields(
    docs: DataFrame, text_col: str = "text", qr_col: str | None = None, fuzzy: bool = True, rules: DataFrame | list[tuple] | None = None, entities_col: str | None = None
) -> DataFrame:
    """Classified documents with ``fields``, the array of their detected fields in rule order.

    A document meets the rules of its type, which are part of the plan, without a join or shuffle; the first step of the cascade that
    has a value wins. Documents of other types, or none, get what the universal scan finds. ``rules`` are those of a user
    (see ``functions.rules.rule_rows``); ``qr_col`` has the XML of a document's code, ``entities_col`` what a model has found in its text."""
    rows = default_rules() if rules is None else rule_rows(rules)
    kinds = list(dict.fromkeys(r[0] for r in rows))
    kind, text = F.col("document_type"), F.col("_text")
    extra = {"_qr": qr_col, "_entities": entities_col}
    base = docs.select("*", F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(n) for n, c in extra.items() if c])
    base = base.withColumn("_mrz", F.when(kind == "passport", parse_mrz(text)))
    outcomes = _outcomes(docs.sparkSession.sparkContext.applicationId, rows, qr_col is not None, entities_col is not None)
    typed = F.coalesce(kind.isin(kinds), F.lit(False))
    fields = F.when(typed, _settled(outcomes, text, fuzzy)).otherwise(universal_fields(text, F.col("_entities") if entities_col else None))
    # a generator of one row, so that what reads the fields more than once does not find them anew each time
    return base.select("*", F.explode(F.array(fields)).alias("fields")).drop("_text", "_mrz", "_qr", "_entities")


@F.pandas_udf(StringType())
def _literal_forms(patterns: pd.Series) -> pd.Series:
    return patterns.map(literal_form, na_action="ignore")


#: Columns of a rule in a document's array of rules.
_RULE = ("rule_pos", "field_name", "weight", "method", "pattern", "template", "threshold", "anchors", "always_redact", "required_in")
#: Bytes of rule tables that are broadcast; larger ones meet the documents by a shuffle on the type.
MAX_BROADCAST_BYTES = 8 << 20


def rules_by_type(rules: DataFrame) -> DataFrame:
    """document_type and ``rules``, the array of its rules in order, from a table of any number of rules (``rule_pos`` and ``RULE_COLUMNS``).

    The table is worked on where it is; only distinct patterns go to Python, for their literal forms. Rules without a type fit no document."""
    forms = rules.where("pattern is not null").select("pattern").distinct().withColumn("template", _literal_forms("pattern"))
    rows = rules.where("document_type is not null").join(forms, "pattern", "left")
    return rows.groupBy("document_type").agg(F.array_sort(F.collect_list(F.struct(*_RULE))).alias("rules"))


def _applied(r: Column, text: Column, mrz: Column, qr: Column | None, entities: Column | None) -> Column:
    """What the steps of a rule find in a text; as ``_outcome``, but the rule is a value of the row."""
    from .entities import best_entity

    field, method, anchors = r["field_name"], r["method"], r["anchors"]
    named = lambda names, value: F.create_map(*[x for n in names for x in (F.lit(n), value(n))])
    early, later = [], []
    if qr is not None:
        codes = named([*QR_FIELDS, "address"], lambda n: qr_address(qr) if n == "address" else F.xpath_string(qr, F.lit(f"/*/@{QR_FIELDS[n]}")))
        early.append(F.when(F.contains(method, F.lit("qr_primary")), _step(F.try_element_at(codes, field), 0.98, "qr")))
    early.append(F.when(F.contains(method, F.lit("mrz_primary")), _step(F.try_element_at(named(MRZ_FIELDS, lambda n: mrz[n]), field), 0.95, "mrz")))
    has_pattern = F.coalesce(r["pattern"], F.lit("")) != ""
    pattern = F.concat(F.lit("(?i)"), r["pattern"])
    early.append(F.when(has_pattern, _step(_first(text, pattern), 0.95, "regex_fuzzy")))
    later.append(F.when(has_pattern, _step(anchored_match(text, pattern, anchors), 0.82, "regex_fuzzy")))
    ner = F.contains(method, F.lit("ner"))
    if entities is not None:
        later.append(F.when(ner, once(best_entity(entities, text, field, anchors), lambda b: _step(b["value"], b["confidence"], "ner"))))
    later.append(F.when(ner, _step(anchored_words(text, field, anchors), 0.55, "ner")))
    later.append(F.when((method == "image") & (field == "signature"), _step(F.lit("SIGNATURE_REGION"), 0.6, "image")))
    own = [r[c].alias(c) for c in ("rule_pos", "field_name", "weight", "always_redact")]
    return _steps(own, early, later, F.when(has_pattern, r["template"]), r["threshold"].cast("double"))


def with_fields_of_rules(docs: DataFrame, rules: DataFrame, text_col: str = "text", qr_col: str | None = None, fuzzy: bool = True, entities_col: str | None = None) -> DataFrame:
    """As ``with_fields``, with a table of any number of rules that is joined with the documents on their type instead of being part of the plan.

    ``rules``, the array of a document's rules, stays beside ``fields``; ``policy.judged_by`` reads it."""
    by_type = rules_by_type(rules)
    size = F.length(F.to_json("rules"))
    held = by_type.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    by_type = F.broadcast(by_type) if held <= MAX_BROADCAST_BYTES else by_type
    extra = {"_qr": qr_col, "_entities": entities_col}
    base = docs.drop("rules").select("*", F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(n) for n, c in extra.items() if c]).join(by_type, "document_type", "left")
    mrz, text = F.when(F.col("document_type") == "passport", parse_mrz(F.col("_text"))), F.col("_text")
    qr, entities = (F.col(n) if c else None for n, c in extra.items())
    outcomes = once(mrz, lambda m: F.transform("rules", lambda r: _applied(r, text, m, qr, entities)))
    fields = F.when(F.col("rules").isNotNull(), _settled(outcomes, text, fuzzy)).otherwise(universal_fields(text, entities))
    return base.select("*", F.explode(F.array(fields)).alias("fields")).drop("_text", *extra)


def field_rows(docs: DataFrame, *dropped: str) -> DataFrame:
    """One row for each of a document's ``fields``: the other columns of ``docs``, those of the field, and needs_review."""
    others = [c for c in docs.columns if c not in ("fields", *dropped)]
    return docs.select(*others, F.inline("fields")).withColumn("needs_review", F.col("confidence") < 0.7)


def extract_fields(
    docs: DataFrame, text_col: str = "text", qr_col: str | None = None, fuzzy: bool = True, rules: DataFrame | list[tuple] | None = None, entities_col: str | None = None
) -> DataFrame:
    """Detected fields of classified documents, one row each: the columns of ``docs`` without the text, and those of ``field_rows``; see ``with_fields``."""
    found = with_fields(docs, text_col, qr_col, fuzzy, rules, entities_col)
    return field_rows(found, *[c for c in (text_col, qr_col, entities_col) if c])
