"""DuckDB SQL for the registered queries, made from the same rule tables but in plain relational form."""

from __future__ import annotations

from ..functions import rules as R
from ..operators.history import NOTES
from ..sources.tables import ID_CARDS


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CARDS = f"cards AS ({ID_CARDS.format(s='VARCHAR', div='//', customer='customer')})"
TEXTS = f"{CARDS}, texts AS (SELECT 'doc' AS src, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'card', doc_id, text FROM cards)"


def _match(pattern: str, text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, 0, 'i'), '')"


def _after(anchor: str, text: str = "text") -> str:
    at = f"strpos(lower({text}), {_q(anchor)})"
    return f"CASE WHEN {at} > 0 THEN ltrim(regexp_replace(substr({text}, {at} + {len(anchor)}), '^\\s+|\\s+$', '', 'g'), ':') END"


def _anchored(pattern: str, anchors: list[str]) -> str:
    return "coalesce(" + ", ".join([_match(pattern, f"({_after(a)})") for a in anchors] + ["NULL"]) + ")"


def _ner(field: str, anchors: list[str]) -> str:
    skip, black = (", ".join(map(_q, x)) for x in (R.SKIP_WORDS, R.NAME_BLACKLIST))
    tries = []
    for a in anchors:
        parts = f"list_filter(list_filter(string_split_regex({_after(a)}, '\\s+'), lambda w: w <> '')[1:5], lambda w: lower(w) NOT IN ({skip}))"
        value = f"nullif(array_to_string({parts}, ' '), '')"
        if field in ("name", "father_name"):
            own = f"list_distinct(regexp_extract_all(lower({value}), '\\w+'))"
            value = f"CASE WHEN len({own}) = 0 OR len(list_intersect({own}, [{black}])) / len({own}) <= 0.3 THEN {value} END"
        tries.append(value)
    return f"coalesce({', '.join([*tries, 'NULL'])})"


def _scores() -> dict[str, str]:
    out = {}
    for kind, (keys, patterns) in R.KEYWORDS.items():
        points = [f"contains(lower(text), {_q(k)})::INT" for k in keys] + [f"regexp_matches(text, {_q(p)}, 'i')::INT * 2" for p in patterns]
        out[kind] = f"({' + '.join(points)}) / {len(keys) + 2 * len(patterns)}"
    return out


SCORES = _scores()
_best = "greatest(" + ", ".join(f"s_{k}" for k in SCORES) + ")"
CLASSIFIED = f"""{CARDS}, scored AS (SELECT *, {', '.join(f'{s} AS s_{k}' for k, s in SCORES.items())} FROM cards),
classified AS (SELECT doc_id, true_type, context, text, {_best} AS type_confidence, CASE WHEN {_best} < {R.MIN_TYPE_SCORE} THEN 'unknown' {' '.join(f"WHEN s_{k} = {_best} THEN '{k}'" for k in SCORES)} END AS document_type FROM scored)"""

MRZ = r"""mrz_raw AS (SELECT doc_id, nullif(regexp_extract(text, '[A-Z0-9<]{44}\s*\n?\s*[A-Z0-9<]{44}', 0), '') AS pair FROM cards),
mrz_two AS (SELECT doc_id, left(pair, 44) AS l1, right(pair, 44) AS l2 FROM mrz_raw WHERE pair LIKE 'P%'),
mrz AS (SELECT doc_id, replace(substr(l2, 1, 9), '<', '') AS passport_number, trim(concat_ws(' ', trim(replace(split_part(substr(l1, 6), '<<', 1), '<', ' ')), trim(replace(split_part(substr(l1, 6), '<<', 2), '<', ' ')))) AS name,
  substr(l2, 11, 3) AS nationality, concat(substr(l2, 18, 2), '/', substr(l2, 16, 2), '/', CASE WHEN substr(l2, 14, 2)::INT > 40 THEN '19' ELSE '20' END, substr(l2, 14, 2)) AS dob,
  CASE substr(l2, 21, 1) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE substr(l2, 21, 1) END AS sex,
  concat(substr(l2, 26, 2), '/', substr(l2, 24, 2), '/', CASE WHEN substr(l2, 22, 2)::INT > 40 THEN '19' ELSE '20' END, substr(l2, 22, 2)) AS date_of_expiry, concat(l1, chr(10), l2) AS mrz_lines FROM mrz_two)"""


def _universal(source: str, keys: str) -> str:
    """found: one row per universal rule that matches, values that differ (they do for these patterns and texts)."""
    parts = [f"SELECT {keys}, {i} AS rule_pos, {_q(n)} AS field_name, {w} AS weight, {_match(p)} AS value FROM {source}" for i, (n, w, p) in enumerate(R.UNIVERSAL)]
    return f"found_all AS ({' UNION ALL '.join(parts)}), found AS (SELECT * FROM found_all a WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM found_all b WHERE {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND b.rule_pos < a.rule_pos AND lower(b.value) = lower(a.value)))"


def _fields() -> str:
    parts = []
    for i, (kind, field, weight, method, pattern, _t, anchors, always, _p) in enumerate(R.FIELDS):
        steps = []
        if "mrz_primary" in method:
            steps.append((f"(SELECT m.{field} FROM mrz m WHERE m.doc_id = c.doc_id)", 0.95, "mrz"))
        if pattern:
            steps += [(_match(pattern), 0.95, "regex_fuzzy"), (_anchored(pattern, anchors), 0.82, "regex_fuzzy")]
        if "ner" in method:
            steps.append((_ner(field, anchors), 0.55, "ner"))
        if field == "signature":
            steps.append(("'SIGNATURE_REGION'", 0.6, "image"))
        if not steps:
            continue
        tries = ", ".join(f"CASE WHEN v{j} IS NOT NULL THEN {{'value': v{j}, 'confidence': {c}::DOUBLE, 'method': '{m}'}} END" for j, (_, c, m) in enumerate(steps))
        inner = ", ".join(f"{s} AS v{j}" for j, (s, _, _) in enumerate(steps))
        parts.append(f"SELECT doc_id, context, document_type, {i} AS rule_pos, {_q(field)} AS field_name, {weight} AS weight, {str(always).lower()} AS always_redact, unnest(coalesce({tries}, NULL)) FROM (SELECT doc_id, context, document_type, {inner} FROM classified c WHERE document_type = '{kind}')")
    universal = "SELECT doc_id, context, document_type, rule_pos, field_name, weight, false, value, 0.85::DOUBLE, 'regex_fuzzy' FROM found"
    unknown = "unknown_docs AS (SELECT * FROM classified WHERE document_type = 'unknown')"
    return f"{CLASSIFIED}, {MRZ}, {unknown}, {_universal('unknown_docs', 'doc_id, context, document_type')}, fields_all AS ({' UNION ALL '.join([*parts, universal])}), fields AS (SELECT *, confidence < 0.7 AS needs_review FROM fields_all WHERE value IS NOT NULL)"


FIELDS = _fields()
NECESSITY = "necessity(document_type, field_name, context, required) AS (VALUES " + ", ".join(f"({_q(t)}, {_q(f)}, {_q(c)}, {str(r).lower()})" for t, f, c, r in R.necessity_rows()) + ")"
JUDGED = f"{FIELDS}, {NECESSITY}, judged AS (SELECT f.*, coalesce(n.required, false) AS required, CASE WHEN always_redact THEN 'redact' WHEN coalesce(n.required, false) THEN 'allow' ELSE 'redact' END AS decision FROM fields f LEFT JOIN necessity n USING (document_type, field_name, context))"
DECIDED = f"{JUDGED}, submitted AS (SELECT doc_id, field_name, CASE (doc_id + length(field_name)) % 4 WHEN 0 THEN 'redact' WHEN 1 THEN 'mask' WHEN 2 THEN 'allow' END AS submitted FROM fields), decided AS (SELECT j.*, s.submitted, CASE WHEN always_redact THEN 'redact' ELSE coalesce(s.submitted, 'allow') END AS applied FROM judged j JOIN submitted s USING (doc_id, field_name))"
_PENALTY = "CASE WHEN always_redact OR NOT required THEN weight * 10 ELSE weight * 2 END"
_SCORE = "CASE WHEN coalesce({1}, 0) = 0 THEN 0 ELSE round(least(100.0::DOUBLE * {0} / {1}, 100), 1) END::DOUBLE"
_ALL, _SEEN = [[f"sum({x}){f}" for x in (_PENALTY, "weight * 10")] for f in ("", " FILTER (submitted = 'allow' AND NOT always_redact)")]
BEFORE = f"before AS (SELECT c.doc_id, {_SCORE.format(*_ALL)} AS pei_before FROM cards c LEFT JOIN judged j USING (doc_id) GROUP BY c.doc_id)"
AFTER = f"after_ AS (SELECT c.doc_id, {_SCORE.format(*_SEEN)} AS pei_after FROM cards c LEFT JOIN decided d USING (doc_id) GROUP BY c.doc_id)"
_word = r"[\p{L}\p{N}_]+"
#: A signature's region, and the page, are those of the query.
BOXES = rf"""{DECIDED}, words AS (SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM cards)),
placed AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS word, (pos % 10) * 80.0::DOUBLE AS x, (pos // 10) * 20.0::DOUBLE AS y, length(text) * 8.0::DOUBLE AS w FROM words),
vals AS (SELECT doc_id, document_type, field_name, value, method, applied, confidence, document_type <> 'unknown' AND method IN ('regex_fuzzy', 'ner') AS by_parts, regexp_extract_all(lower(value), '{_word}') AS own FROM decided),
parts AS (SELECT *, CASE WHEN len(list_filter(own, lambda p: length(p) >= 2)) > 0 THEN list_filter(own, lambda p: length(p) >= 2) ELSE [trim(lower(value))] END AS part FROM vals),
u AS (SELECT v.doc_id, v.field_name, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + 16) AS y1 FROM parts v JOIN placed p ON v.doc_id = p.doc_id AND p.word <> '' AND v.method <> 'image'
  AND CASE WHEN by_parts THEN len(list_filter(part, lambda q: contains(q, word) OR contains(word, q))) > 0 ELSE list_contains(own, word) END GROUP BY ALL),
boxes AS (SELECT v.doc_id, v.document_type, v.field_name, v.applied, v.confidence, CASE WHEN method = 'image' THEN 40 ELSE coalesce(x0, 0) END::DOUBLE AS x, CASE WHEN method = 'image' THEN 900 ELSE coalesce(y0, 0) END::DOUBLE AS y,
  CASE WHEN method = 'image' THEN 320 ELSE coalesce(x1 - x0, 1) END::DOUBLE AS width, CASE WHEN method = 'image' THEN 240 ELSE coalesce(y1 - y0, 1) END::DOUBLE AS height FROM vals v LEFT JOIN u USING (doc_id, field_name)),
corners AS (SELECT doc_id, field_name, applied, greatest(trunc(x) - 4, 0) AS x0, greatest(trunc(y) - 4, 0) AS y0, least(trunc(x) + trunc(width) + 4, 800) AS x1, least(trunc(y) + trunc(height) + 4, 1200) AS y1 FROM boxes)"""
_SCANS = """scans AS (SELECT 'scan-' || doc_id AS scan_id, concat('2024-01-', lpad((1 + doc_id % 28)::VARCHAR, 2, '0'), 'T00:00:00+00:00') AS "timestamp", concat('File_', doc_id, '.png') AS filename, document_type, context AS declared_context,
  (doc_id % 101)::DOUBLE AS pei_before, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE doc_id % 21 END::DOUBLE AS pei_after, doc_id % 4 AS needs_review_count, v::BIGINT AS version FROM classified, unnest([1, 2]) AS t(v) WHERE v = 1 OR doc_id % 3 = 0),
latest AS (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY version DESC) = 1)"""
SCANS = f"{CLASSIFIED}, {_SCANS}"
_RISK = "CASE WHEN {0} >= 60 THEN 'high' WHEN {0} >= 30 THEN 'medium' ELSE 'low' END"


def _explain() -> str:
    pct = "CAST(round_even(confidence * 100, 0) AS INT) || '%'"
    return f"""CASE method
 WHEN 'mrz' THEN field_name || ' decoded from the Machine Readable Zone (MRZ) at the bottom of the passport. MRZ lines encode the complete identity in a standardised format.'
 WHEN 'regex_fuzzy' THEN concat(field_name, ' detected because the extracted text ''', left(value, 30), CASE WHEN length(value) > 30 THEN '...' ELSE '' END, ''' matches the ', document_type, ' identifier pattern (confidence: ', {pct}, '). ', CASE WHEN confidence > 0.92 THEN 'Exact match.' ELSE 'Approximate match — verify if incorrect.' END)
 WHEN 'ner' THEN concat(field_name, ' detected as a ', CASE WHEN field_name IN ('name', 'father_name', 'father_husband_name', 'father_spouse_name') THEN 'personal name (PER entity)' WHEN field_name IN ('address', 'place_of_birth') THEN 'location entity (LOC)' ELSE 'named entity' END, ' by the NER model near the keyword anchor. Confidence: ', {pct}, '.')
 WHEN 'image' THEN field_name || ' detected as a visual element (QR code / signature / photo region) in the document image. Always flagged regardless of context.' END"""


def _highlight() -> str:
    text = "text"
    for n, _, p in R.UNIVERSAL:
        value = _match(p, "t.text")
        text = f"CASE WHEN {value} IS NULL THEN {text} ELSE replace({text}, {value}, concat('[{n}:', {value}, ']')) END"
    return text


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in names.items())} ELSE {column} END"


def _audit() -> str:
    field = "{'field_name': field_name, 'detected_value_masked': CASE WHEN length(value) <= 4 THEN '****' ELSE left(value, 4) || '****' END, 'sensitivity_weight': weight, 'detection_method': method, 'confidence': round(confidence, 2), 'needs_review': needs_review, 'required': required, 'redaction_decision': applied, 'always_redact': always_redact, 'explanation': explanation}"
    keys = "scan_id,timestamp,filename,document_type,document_type_confidence,declared_context,pei_before,pei_after,fields_detected,compliance_notes,redacted_file_path"
    notes = "to_json({" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in NOTES.items()) + "})::VARCHAR"
    return f"""WITH {DECIDED}, {BEFORE}, {AFTER}, told AS (SELECT *, {_explain()} AS explanation FROM decided), listed AS (SELECT doc_id, to_json(list({field} ORDER BY rule_pos))::VARCHAR AS fields_detected FROM told GROUP BY doc_id)
SELECT c.doc_id, 'scan-' || c.doc_id AS scan_id, concat('2024-01-', lpad((1 + c.doc_id % 28)::VARCHAR, 2, '0'), 'T00:00:00+00:00') AS "timestamp", concat('File_', c.doc_id, '.png') AS filename, document_type, round(type_confidence, 3) AS document_type_confidence, context AS declared_context,
  round(pei_before, 1) AS pei_before, round(pei_after, 1) AS pei_after, CASE WHEN c.doc_id % 3 = 0 THEN concat('redacted/', c.doc_id, '.png') ELSE '' END AS redacted_file_path, coalesce(fields_detected, '[]') AS fields_detected, {notes} AS compliance_notes, {_q(keys)} AS report_keys
FROM classified c JOIN before USING (doc_id) JOIN after_ USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def _entities() -> str:
    """best: doc_id, field_name, value, confidence of the entities of the query."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, text, '{g}' AS g, nullif(regexp_extract(text, '{p}', 0), '') AS word, ({s})::DOUBLE AS score, {i} AS ord FROM cards"
        for i, (g, p, s) in enumerate([("PER", "Government of India|INCOME TAX DEPARTMENT|ELECTION COMMISSION OF INDIA", "0.99"), ("PER", "(ASHA|VIJAY|MEERA) (RAO|PATEL|KHAN|DAS)", "0.5 + (doc_id % 5) / 10"), ("PER", "RAVI (RAO|PATEL|KHAN|DAS)", "0.6"), ("LOC", "Rampur|Pune|PUNE", "0.8")])
    )
    black = ", ".join(map(_q, R.NAME_BLACKLIST))
    tries = []
    for name, field, group, anchors in [("name", "name", "PER", ["name", "नाम"]), ("father_name", "father_name", "PER", ["father", "father's name"]), ("address", "address", "LOC", ["address", "pin"]), ("elector", "name", "PER", ["elector's name", "name"])]:
        own = r"list_distinct(regexp_extract_all(lower(word), '\w+'))"
        clean = f"AND len(list_intersect({own}, [{black}])) / len({own}) <= 0.3" if field != "address" else ""
        near = "least(length(text), " + ", ".join(f"CASE WHEN strpos(lower(text), {_q(a)}) > 0 THEN abs(strpos(text, word) - strpos(lower(text), {_q(a)})) ELSE length(text) END" for a in anchors) + ")"
        tries.append(f"SELECT doc_id, '{name}' AS field_name, word AS value, ord, score * 0.7::DOUBLE + greatest(0, 1 - {near} / length(text)) * 0.3::DOUBLE AS confidence FROM ent WHERE g = '{group}' AND word IS NOT NULL {clean}")
    return f"ent AS ({found}), tries AS ({' UNION ALL '.join(tries)}), best AS (SELECT doc_id, field_name, value, least(confidence, 0.95)::DOUBLE AS confidence FROM tries QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY confidence DESC, ord) = 1)"


def _approximate() -> str:
    """Windows with enough of a template's characters, and the longest common subsequence of each with it by the bits of a number."""
    tried = []
    for name, pattern, threshold in (("aadhaar", R.AADHAAR, 85.0), ("pan", R.PAN, 88.0), ("epic", R.EPIC, 80.0)):
        template = R.TEMPLATES[pattern]
        m, full = len(template), (1 << len(template)) - 1
        bits = " ".join(f"WHEN {_q(c)} THEN {sum(1 << i for i, d in enumerate(template) if d == c)}" for c in sorted(set(template)))
        fits = f"200.0 * least(length(c) - length(translate(c, {_q(''.join(sorted(set(template))))}, '')), {m}) > {threshold} * (length(c) + {m})"
        row = f"list_reduce(list_transform(string_split(c, ''), lambda x: (CASE x {bits} ELSE 0 END)::BIGINT), lambda r, h: ((r + (r & h)) | (r - (r & h))) & {full}, {full}::BIGINT)"
        tried.append(f"SELECT src, doc_id, {_q(name)} AS field_name, value, n, start, {threshold}::DOUBLE AS threshold, 200.0::DOUBLE * ({m} - bit_count({row})) / (length(c) + {m}) AS score FROM windows WHERE {fits}")
    fixtures = "SELECT * FROM (VALUES ('literal', -1::BIGINT, '00000000000'), ('literal', -2, '0000000000000'), ('literal', -3, 'AAA0-97'), ('literal', -4, 'ABCDE1234F')) AS t(src, doc_id, text)"
    return f"""WITH {TEXTS}, all_texts AS (SELECT src, doc_id, text FROM texts UNION ALL {fixtures}), w AS (SELECT src, doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM all_texts),
windows AS (SELECT *, array_to_string(w[start + 1:start + n], '') AS c, array_to_string(w[start + 1:start + n], ' ') AS value FROM (SELECT src, doc_id, w, n, unnest(range(len(w) - n + 1)) AS start FROM w, unnest([1, 2, 3, 4, 5]) AS t(n) WHERE len(w) >= n)),
tried AS ({' UNION ALL '.join(tried)}) SELECT src, doc_id, field_name, value, round(score / 100, 9) AS confidence FROM tried WHERE score > threshold QUALIFY row_number() OVER (PARTITION BY src, doc_id, field_name ORDER BY score DESC, n, start) = 1"""


def _unknown_entities() -> str:
    """Universal fields of the cards, then the best person and place among the entities, as far as their values are new."""
    black = ", ".join(map(_q, R.NAME_BLACKLIST))
    own = r"list_distinct(regexp_extract_all(lower(word), '\w+'))"
    person = f"SELECT doc_id, word AS value, least(score * 0.7, 0.95)::DOUBLE AS confidence FROM ent WHERE g = 'PER' AND word IS NOT NULL AND len(list_intersect({own}, [{black}])) / len({own}) <= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1"
    places = f"SELECT doc_id, word, score, ord FROM ent WHERE g = 'LOC' AND word IS NOT NULL UNION ALL SELECT doc_id, upper(nullif(regexp_extract(text, {_q(R.DATE)}, 0), '')), 0.9, 9 FROM cards WHERE doc_id % 3 = 0 AND regexp_matches(text, {_q(R.DATE)})"
    place = f"SELECT doc_id, word AS value, least(score * 0.7, 0.95)::DOUBLE AS confidence FROM ({places}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1"
    fresh = "NOT EXISTS (SELECT 1 FROM {1} f WHERE f.doc_id = {0}.doc_id AND lower(f.value) = lower({0}.value))"
    return f"""WITH {CARDS}, {_entities()}, {_universal('cards', 'doc_id')}, person AS ({person}), place AS ({place}), named AS (SELECT doc_id, value FROM found UNION ALL SELECT doc_id, value FROM person)
SELECT doc_id, field_name, value, weight::BIGINT AS weight, 0.85::DOUBLE AS confidence, 'regex_fuzzy' AS method FROM found UNION ALL SELECT doc_id, 'name', value, 5, round(confidence, 9), 'ner' FROM person WHERE {fresh.format('person', 'found')}
UNION ALL SELECT doc_id, 'address', value, 5, round(confidence, 9), 'ner' FROM place WHERE {fresh.format('place', 'named')}"""


def _by_table() -> str:
    """Each keyword held against each text."""
    keys = ", ".join(f"({_q(t)}, {i}, {_q(k)})" for i, (t, (ks, _)) in enumerate(R.KEYWORDS.items()) for k in ks)
    patterns = ", ".join(f"({_q(t)}, {_q(p)})" for t, (_, ps) in R.KEYWORDS.items() for p in ps)
    return f"""WITH {TEXTS}, pattern(t, p) AS (VALUES {patterns}),
keyword AS (SELECT * FROM (VALUES {keys}) a(t, pos, k) UNION ALL SELECT concat('house_', c_custkey // 4), c_custkey + 100, concat('house ', c_custkey, ' ') FROM customer),
total AS (SELECT t, min(pos) AS pos, count(*) + 2 * (SELECT count(*) FROM pattern p WHERE p.t = k.t) AS points FROM keyword k GROUP BY t),
hit AS (SELECT src, doc_id, t, 1 AS n FROM texts JOIN keyword ON contains(lower(text), k) UNION ALL SELECT src, doc_id, t, 2 FROM texts JOIN pattern ON regexp_matches(text, p, 'i')),
score AS (SELECT src, doc_id, t, any_value(pos) AS pos, sum(n)::DOUBLE / any_value(points) AS s FROM hit JOIN total USING (t) GROUP BY ALL),
best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY src, doc_id ORDER BY s DESC, pos, t) = 1)
SELECT src, doc_id, CASE WHEN s >= {R.MIN_TYPE_SCORE} THEN t ELSE 'unknown' END AS document_type, round(coalesce(s, 0), 9)::DOUBLE AS type_confidence FROM texts LEFT JOIN best USING (src, doc_id)"""


#: Words of the engines, from the cards' texts without any JSON between.
_WORDS = f"""{CARDS}, listed AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM cards),
word AS (SELECT doc_id, len(ws) AS n, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM listed),
seen AS (SELECT doc_id, 'lines' AS kind, i AS pos, w AS text, CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, i * 10 AS x, 3 AS y, 9 AS width, 12 AS height FROM word
  UNION ALL SELECT doc_id, 'blocks', i, w, ((i % 10) / 10)::DOUBLE, i * 8, 2, 7, 10 FROM word WHERE i < 3 OR doc_id % 4 <> 0)"""
_CHAIN = f"""WITH {_WORDS}, page AS (SELECT doc_id, kind, count(*) AS n, avg(confidence) AS c, string_agg(text, ' ' ORDER BY pos) AS text FROM seen GROUP BY doc_id, kind),
pick AS (SELECT doc_id, CASE WHEN l.c >= 0.72 AND l.n >= 5 THEN 1 WHEN b.n >= 5 THEN 2 WHEN doc_id % 5 <> 0 THEN 3 ELSE 1 END AS engine, l.n AS ln, l.c AS lc, l.text AS lt, b.n AS bn, b.c AS bc, b.text AS bt
  FROM (SELECT * FROM page WHERE kind = 'lines') l JOIN (SELECT * FROM page WHERE kind = 'blocks') b USING (doc_id))
SELECT doc_id, engine::BIGINT AS engine, CASE engine WHEN 2 THEN bn ELSE ln END AS n_words, round(CASE engine WHEN 2 THEN bc ELSE lc END, 6) AS avg_confidence, md5(CASE engine WHEN 2 THEN bt ELSE lt END) AS text_md5 FROM pick"""


def oracles() -> dict[str, str]:
    out = {}
    for name, p in (("email", R.EMAIL), ("phone", R.PHONE), ("pan", R.PAN), ("aadhaar", R.AADHAAR), ("passport", R.PASSPORT), ("date", R.DATE)):
        out[f"detect_{name}"] = f"WITH {TEXTS} SELECT src, doc_id, {_match(p)} AS value FROM texts WHERE {_match(p)} IS NOT NULL"
    for name, p in (("dl", R.DL), ("epic", R.EPIC), ("gender", R.GENDER_A), ("blood_group", R.BLOOD)):
        out[f"detect_{name}"] = f"WITH {TEXTS} SELECT src, doc_id, {_match(p)} AS value FROM texts WHERE {_match(p)} IS NOT NULL"
    scan = f"WITH {TEXTS}, {_universal('texts', 'src, doc_id')}"
    counts = f"{scan}, n AS (SELECT src, doc_id, count(*) AS n FROM found GROUP BY ALL)"
    out |= {
        "universal_scan": f"{scan} SELECT src, doc_id, field_name, value, weight::BIGINT AS weight, 0.85::DOUBLE AS confidence FROM found",
        "scan_text_pei": f"{counts} SELECT src, doc_id, coalesce(n, 0) AS n_fields, CASE WHEN n > 0 THEN 100 ELSE 0 END::DOUBLE AS pei_before FROM texts LEFT JOIN n USING (src, doc_id)",
        "scan_text_highlight": f"WITH {TEXTS} SELECT src, doc_id, md5({_highlight()}) AS highlight_md5 FROM texts t",
        "docs_with_pii": f"{scan} SELECT src, doc_id FROM texts WHERE (src, doc_id) IN (SELECT (src, doc_id) FROM found)",
        "docs_without_pii": f"{scan} SELECT src, doc_id FROM texts t WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.src = t.src AND f.doc_id = t.doc_id)",
        "keyword_scores": f"WITH {CARDS} SELECT doc_id, {', '.join(f'{s} AS score_{k}' for k, s in SCORES.items())} FROM cards",
        "classify_documents": f"WITH {CLASSIFIED} SELECT doc_id, true_type, document_type, type_confidence FROM classified",
        "type_distribution": f"WITH {CLASSIFIED} SELECT document_type, count(*) AS n, avg((document_type = true_type)::INT) AS accuracy FROM classified GROUP BY document_type",
        "type_context_rollup": f"WITH {CLASSIFIED} SELECT document_type, context, count(*) AS n FROM classified GROUP BY ROLLUP (document_type, context)",
        "mrz_parse": f"WITH {CARDS}, {MRZ} SELECT * FROM mrz",
        "anchored_regex": f"WITH {CARDS}, glued AS (SELECT doc_id, replace(text, 'Number ', 'Number') AS text FROM cards WHERE true_type = 'pan') SELECT doc_id, {_match(R.PAN)} AS exact, {_anchored(R.PAN, ['permanent account number', 'pan', 'income tax'])} AS anchored FROM glued",
        "keyword_anchor_name": f"WITH {CARDS} SELECT doc_id, {_ner('name', ['name', 'नाम'])} AS name FROM cards",
        "ngram_candidates": f"WITH {TEXTS}, w AS (SELECT src, doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM texts), s AS (SELECT src, doc_id, w, n, unnest(range(len(w) - n + 1)) AS start FROM w, unnest([1, 2, 3, 4, 5]) AS t(n) WHERE len(w) >= n) SELECT src, doc_id, n::BIGINT AS n, start, array_to_string(w[start + 1:start + n], ' ') AS candidate FROM s",
        "extract_fields": f"WITH {FIELDS} SELECT doc_id, document_type, field_name, value, confidence, method, needs_review FROM fields",
        "necessity_matrix": f"WITH {CLASSIFIED}, {NECESSITY}, n AS (SELECT document_type, context, count(*) AS n FROM classified GROUP BY ALL) SELECT document_type, field_name, context, required, coalesce(n, 0) AS n_cards FROM necessity LEFT JOIN n USING (document_type, context)",
        "fuzzy_best": _approximate(),
        "extract_by_rule_table": f"WITH {JUDGED} SELECT doc_id, field_name, value, confidence, method, required FROM judged",
        "stored_scans": f"WITH {CARDS} SELECT 'scan-' || doc_id AS scan_id, concat('File_', doc_id, '.png') AS filename, (doc_id % 101)::DOUBLE AS pei_before, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN doc_id % 21 END::DOUBLE AS pei_after, CASE WHEN doc_id % 2 = 0 THEN 'redacted/' || doc_id END AS redacted_file_path, (1 + (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT)::BIGINT AS version FROM cards WHERE doc_id % 10 <> 9",
        "stored_scan_fields": f"WITH {FIELDS} SELECT 'scan-' || doc_id AS scan_id, document_type, count(*) AS n_fields, sum(weight)::BIGINT AS weight, ((doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT)::BIGINT AS n_events FROM fields WHERE doc_id % 10 <> 9 GROUP BY doc_id, document_type",
        "stored_orphans": f"WITH {FIELDS}, e AS (SELECT doc_id, 'redacted' AS name FROM cards WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'cleared' FROM cards WHERE doc_id % 3 = 0) SELECT 'scan-' || doc_id AS scan_id, 'field' AS kind, field_name AS name FROM fields WHERE doc_id % 10 = 9 UNION ALL SELECT 'scan-' || doc_id, 'event', name FROM e WHERE doc_id % 10 = 9",
        "unknown_with_entities": _unknown_entities(),
        "necessity_lookup": f"WITH {JUDGED} SELECT doc_id, field_name, context, required FROM judged",
        "excess_fields": f"WITH {JUDGED} SELECT doc_id, count(*) FILTER (NOT required) AS n_excess, count(*) FILTER (required) AS n_required, count(*) AS n_fields FROM judged GROUP BY doc_id",
        "default_decisions": f"WITH {JUDGED} SELECT doc_id, field_name, decision FROM judged",
        "apply_decisions": f"WITH {DECIDED} SELECT doc_id, field_name, submitted, applied FROM decided",
        "pei_before": f"WITH {JUDGED}, {BEFORE} SELECT * FROM before",
        "pei_after": f"WITH {DECIDED}, {AFTER} SELECT * FROM after_",
        "pei_projected": f"WITH {JUDGED} SELECT doc_id, least(sum(CASE WHEN required THEN weight * 2 ELSE 0 END), 100)::DOUBLE AS pei_projected_required, least(sum(CASE WHEN decision = 'allow' THEN CASE WHEN required THEN weight * 2 ELSE weight * 10 END WHEN required THEN weight * 2 ELSE 0 END), 100)::DOUBLE AS pei_projected_decisions FROM judged GROUP BY doc_id",
        "pei_reduction": f"WITH {DECIDED}, {BEFORE}, {AFTER} SELECT doc_id, CASE WHEN pei_before > 0 THEN floor((pei_before - pei_after) / pei_before * 100 + 0.5) ELSE 0 END::BIGINT AS reduction FROM before JOIN after_ USING (doc_id)",
        "explanations": f"WITH {FIELDS} SELECT doc_id, field_name, {_explain()} AS explanation FROM fields",
        "masked_values": f"WITH {FIELDS} SELECT doc_id, field_name, CASE WHEN length(value) <= 4 THEN '****' ELSE left(value, 4) || '****' END AS masked, CASE WHEN length(value) <= 4 THEN value ELSE left(value, 4) || '****' END AS displayed FROM fields",
        "needs_review_count": f"WITH {FIELDS} SELECT doc_id, count(*) FILTER (needs_review) AS n_review FROM fields GROUP BY doc_id",
        "confidence_labels": f"WITH {FIELDS} SELECT doc_id, field_name, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS confidence_label, {_RISK.format('weight * 10')} AS field_risk FROM fields",
        "weighted_confidence": f"WITH {FIELDS} SELECT doc_id, round(sum(confidence * weight) / sum(weight), 9) AS weighted_confidence FROM fields GROUP BY doc_id",
        "bbox_union": f"WITH {BOXES} SELECT doc_id, field_name, x, y, width, height FROM boxes",
        "bbox_normalise": f"WITH {BOXES}, t AS (SELECT *, document_type <> 'unknown' AS typed FROM boxes) SELECT doc_id, field_name, CASE WHEN typed THEN round(x / 800 * 100, 2) END AS x, CASE WHEN typed THEN round(y / 1200 * 100, 2) END AS y, CASE WHEN typed THEN round(width / 800 * 100, 2) END AS width, CASE WHEN typed THEN round(height / 1200 * 100, 2) END AS height FROM t",
        "drawable_boxes": f"WITH {BOXES} SELECT doc_id, field_name FROM boxes WHERE width > 0 AND height > 0",
        "redaction_boxes": f"WITH {BOXES} SELECT doc_id, field_name, CASE WHEN applied = 'mask' THEN least(x0 + 40, x1) ELSE x0 END::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM corners WHERE applied <> 'allow'",
        "field_responses": f"WITH {BOXES}, b AS (SELECT *, (doc_id + length(field_name)) % 2 = 0 AS own FROM boxes) SELECT doc_id, field_name, round(confidence / 3, 3) AS confidence, CASE WHEN own THEN x ELSE 0 END AS x, CASE WHEN own THEN y ELSE 0 END AS y, CASE WHEN own THEN width ELSE 1 END AS width, CASE WHEN own THEN height ELSE 1 END AS height FROM b",
        "latest_scan_version": f"WITH {SCANS} SELECT * FROM latest",
        "scan_list": f"WITH {SCANS} SELECT * EXCLUDE (version) FROM latest",
        "scan_by_id": f"WITH {SCANS} SELECT * FROM latest WHERE scan_id = 'scan-42'",
        "history_search": f"WITH {SCANS} SELECT scan_id, filename, document_type FROM latest WHERE contains(lower(coalesce(filename, '')), 'e_12') OR contains(lower(coalesce(document_type, '')), 'e_12')",
        "risk_filter": f"WITH {SCANS} SELECT scan_id, pei_before FROM latest WHERE coalesce(pei_before, 0) >= 60",
        "scan_labels": f"WITH {SCANS} SELECT scan_id, CASE document_type {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in R.TYPE_LABELS.items())} END AS type_label, {_RISK.format('pei_before')} AS risk FROM latest",
        "dashboard_totals": f"WITH {SCANS}, a AS (SELECT count(*) AS n_scans, avg(coalesce(pei_before, 0)) AS b, avg(coalesce(nullif(pei_after, 0), pei_before, 0)) AS c FROM latest) SELECT n_scans, round(b, 9) AS avg_before, round(c, 9) AS avg_after, CASE WHEN b > 0 THEN floor((b - c) / b * 100 + 0.5) ELSE 0 END::BIGINT AS reduction FROM a",
        "top_exposed_fields": f"WITH {JUDGED} SELECT field_name, count(*) AS n FROM judged WHERE NOT required GROUP BY field_name ORDER BY n DESC, field_name LIMIT 8",
        "recent_scans": f'WITH {SCANS} SELECT scan_id, "timestamp" FROM latest ORDER BY "timestamp" DESC, scan_id LIMIT 10',
        "scan_timeline": f"WITH {FIELDS}, {_SCANS}, c AS (SELECT doc_id, count(*) AS n FROM fields GROUP BY doc_id), t AS (SELECT scan_id, l.\"timestamp\", coalesce(n, 0) AS n, {_case('document_type', R.DOCUMENT_LABELS)} AS label FROM latest l LEFT JOIN c ON c.doc_id = substr(scan_id, 6)::BIGINT) SELECT scan_id, \"timestamp\", unnest(range(5)) AS step, unnest(['document uploaded', 'ocr extraction completed', 'classified as ' || label, n || ' fields detected', 'redaction applied']) AS event FROM t",
        "audit_report": _audit(),
        "audit_present": f"WITH {CARDS} SELECT doc_id, 'scan-' || doc_id AS scan_id FROM cards WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0",
        "context_validation": f"WITH {CARDS}, r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN upper(context) WHEN doc_id % 11 = 0 THEN NULL ELSE context END AS context FROM cards) SELECT doc_id, context, doc_id % 9 <> 0 AND doc_id % 11 <> 0 AS accepted FROM r",
        "entity_fields": f"WITH {CARDS}, {_entities()}, f(g, field_name) AS (VALUES " + ", ".join(f"({_q(g)}, {_q(f)})" for g, fields in R.ENTITY_FIELDS.items() for f in fields) + ") SELECT g AS entity_group, field_name, count(*) AS n FROM ent JOIN f USING (g) WHERE word IS NOT NULL GROUP BY ALL",
        "entity_scores": f"WITH {CARDS}, {_entities()} SELECT doc_id, field_name, value, round(confidence, 9) AS confidence FROM best WHERE field_name <> 'elector'",
        "extract_with_entities": f"WITH {CLASSIFIED}, {_entities()} SELECT c.doc_id, 'name' AS field_name, b.value, round(b.confidence, 9) AS confidence, 'ner' AS method, context = 'kyc_onboarding' AS required FROM classified c JOIN best b ON b.doc_id = c.doc_id AND b.field_name = 'elector' WHERE document_type = 'voter_id' UNION ALL SELECT doc_id, 'card', {_match(R.EPIC)}, 0.95::DOUBLE, 'regex_fuzzy', context = 'kyc_onboarding' FROM classified WHERE document_type = 'voter_id'",
        "labels": f"WITH {FIELDS} SELECT doc_id, field_name, {_case('context', R.CONTEXT_LABELS)} AS context_label, {_case('method', R.METHOD_LABELS)} AS method_label FROM fields",
        "email_names": f"WITH {TEXTS} SELECT src, doc_id, split_part({_match(R.EMAIL)}, '@', 1) AS name FROM texts WHERE {_match(R.EMAIL)} IS NOT NULL",
        "scan_keys": f"WITH {CARDS} SELECT doc_id, sha256(concat(doc_id, chr(31), text, chr(31), context)) AS scan_key FROM cards",
        "classify_by_table": _by_table(),
        "recognised_words": f"WITH {_WORDS} SELECT doc_id, kind, pos, text, confidence, x::BIGINT AS x, y::BIGINT AS y, width::BIGINT AS width, height::BIGINT AS height FROM seen",
        "recognition_chain": _CHAIN,
        "word_confidence": f"WITH {CARDS}, w AS (SELECT doc_id, unnest(range(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))) AS pos FROM cards WHERE doc_id % 13 <> 0), m AS (SELECT doc_id, avg(0.5 + ((doc_id + pos) % 10) / 20) AS c, count(*) AS n FROM w GROUP BY doc_id) SELECT doc_id, round(coalesce(c, 0), 9)::DOUBLE AS mean_confidence, coalesce(c, 0) >= 0.72 AND coalesce(n, 0) >= 5 AS good FROM cards LEFT JOIN m USING (doc_id)",
        "stored_fields": f"WITH {CARDS} SELECT doc_id, 'name' AS field_name, 'V' || doc_id AS field_value, 1::BIGINT AS sensitivity_weight, 'regex_fuzzy' AS detection_method, ('0.' || (5 + doc_id % 5))::DOUBLE AS confidence, doc_id % 90 AS x, 2::BIGINT AS y, 0::BIGINT AS width, doc_id % 5 < 2 AS needs_review, false AS required, 'redact' AS redaction_decision FROM cards UNION ALL SELECT doc_id, 'dob', '', 1, 'regex_fuzzy', 0, 0, 0, 0, true, false, 'redact' FROM cards",
        "extract_with_qr": f"WITH {FIELDS}, a AS (SELECT *, doc_id % 2 = 0 AND field_name IN ('aadhaar_number', 'name', 'dob', 'address') AS qr FROM fields WHERE document_type = 'aadhaar') SELECT doc_id, field_name, CASE WHEN NOT qr THEN value WHEN field_name = 'aadhaar_number' THEN '99' || doc_id WHEN field_name = 'name' THEN 'QR NAME' WHEN field_name = 'dob' THEN '01/01/2001' ELSE concat('H', doc_id, ', Town, 411001') END AS value, CASE WHEN qr THEN 0.98 ELSE confidence END::DOUBLE AS confidence, CASE WHEN qr THEN 'qr' ELSE method END AS method FROM a",
        "qr_xml_address": "SELECT c_custkey AS doc_id, concat('H', c_custkey, ', Near Park, Town', c_custkey % 7, ', Pune, MH, ', 411000 + c_custkey % 100) AS address FROM customer",
    }
    return out
