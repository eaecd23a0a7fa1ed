"""Rule tables: fields by document type, universal patterns, classifier keywords, necessity by context.

The values are fixed: results depend on them. ``extract_fields`` and ``with_necessity`` also take rules of a user, as rows of the same
columns or as a DataFrame of them (see ``rule_rows``).
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession

# Patterns; matching ignores case unless said otherwise.
DATE = r"\b(0?[1-9]|[12]\d|3[01])[\/\-](0?[1-9]|1[012])[\/\-]\d{4}\b"
AADHAAR = r"\b\d{4}\s?\d{4}\s?\d{4}\b"
PHONE = r"\b(\+91[\-\s]?)?[6-9]\d{9}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
PASSPORT = r"\b[A-PR-WY][1-9]\d{7}\b"
DL = r"\b[A-Z]{2}[0-9]{2}[A-Z]{0,2}[0-9]{4,7}\b"
EPIC = r"\b[A-Z]{3}[0-9]{7}\b"
BLOOD = r"\b(A|B|AB|O)[+-]\b"
GENDER_A = r"\b(male|female|transgender|पुरुष|महिला)\b"
GENDER_V = r"\b(male|female|others|पुरुष|महिला)\b"
MRZ_LINE = r"[A-Z0-9<]{44}"

#: Literal forms of the patterns, as fuzzy matching compares against them (fixed values).
TEMPLATES = {
    AADHAAR: "0000 0000 0000", DATE: "01-9120301//01-91012//0000", PAN: "AAAAA0-94A", PASSPORT: "A-PR-WY1-90000000", PHONE: r"\91/\s6-9000000000", DL: "AA0-92A0,20-94,7",
    EPIC: "AAA0-97", BLOOD: "ABABO-", GENDER_A: "malefemaletransgenderपुरुषमहिला", GENDER_V: "malefemaleothersपुरुषमहिला", MRZ_LINE: "A-Z0-9<44",
}

TYPES = ["aadhaar", "pan", "passport", "driving_license", "voter_id"]
CONTEXTS = ["age_verification", "identity_verification", "address_proof", "kyc_onboarding", "general_upload"]

#: (type, field, weight, method, pattern, threshold, anchors, always_redact, necessity profile), in order (fixed values).
FIELDS = [
    ("aadhaar", "aadhaar_number", 10, "qr_primary_regex_fallback", AADHAAR, 85, ["aadhaar", "uid", "आधार", "unique"], False, "id"),
    ("aadhaar", "name", 5, "qr_primary_ner_fallback", None, 0, ["name", "नाम"], False, "always"),
    ("aadhaar", "dob", 4, "qr_primary_regex_fallback", DATE, 80, ["dob", "date of birth", "जन्म तिथि", "year of birth", "yob"], False, "dob"),
    ("aadhaar", "gender", 2, "regex_fuzzy", GENDER_A, 75, ["gender", "sex", "लिंग"], False, "never"),
    ("aadhaar", "address", 7, "qr_primary_ner_fallback", None, 0, ["address", "पता", "s/o", "w/o", "d/o", "house", "village", "dist", "pin", "state"], False, "addr"),
    ("aadhaar", "phone", 6, "regex_fuzzy", PHONE, 90, ["mobile", "phone", "contact", "mo."], False, "never"),
    ("aadhaar", "qr_code", 9, "image", None, 0, [], True, "never"),
    ("pan", "pan_number", 10, "regex_fuzzy", PAN, 88, ["permanent account number", "pan", "income tax"], False, "id"),
    ("pan", "name", 5, "ner", None, 80, ["name"], False, "always"),
    ("pan", "father_name", 4, "ner", None, 80, ["father", "father's name"], False, "never"),
    ("pan", "dob", 4, "regex_fuzzy", DATE, 80, ["date of birth", "dob"], False, "dob"),
    ("pan", "signature", 6, "image", None, 80, ["signature"], True, "never"),
    ("passport", "passport_number", 10, "mrz_primary_regex_fallback", PASSPORT, 90, ["passport no", "passport number"], False, "id"),
    ("passport", "name", 5, "mrz_primary_ner_fallback", None, 80, ["surname", "given name"], False, "always"),
    ("passport", "dob", 4, "mrz_primary_regex_fallback", DATE, 80, ["date of birth", "dob"], False, "dob"),
    ("passport", "place_of_birth", 3, "ner", None, 80, ["place of birth", "pob"], False, "never"),
    ("passport", "date_of_expiry", 3, "mrz_primary_regex_fallback", DATE, 80, ["date of expiry", "expiry", "doe"], False, "id"),
    ("passport", "father_spouse_name", 4, "ner", None, 80, ["father", "spouse", "legal guardian"], False, "never"),
    ("passport", "mrz_lines", 10, "mrz", MRZ_LINE, 80, [], True, "never"),
    ("driving_license", "dl_number", 9, "regex_fuzzy", DL, 75, ["licence no", "dl no", "driving licence", "license number", "dl number"], False, "id"),
    ("driving_license", "name", 5, "ner", None, 80, ["name", "holder", "s/o", "w/o", "d/o"], False, "always"),
    ("driving_license", "dob", 4, "regex_fuzzy", DATE, 80, ["dob", "date of birth"], False, "dob"),
    ("driving_license", "address", 7, "ner", None, 80, ["address", "add.", "pin", "district"], False, "addr"),
    ("driving_license", "blood_group", 6, "regex_fuzzy", BLOOD, 85, ["blood", "bg", "blood group"], False, "never"),
    ("voter_id", "epic_number", 9, "regex_fuzzy", EPIC, 80, ["epic no", "elector", "voter id", "election commission", "epic"], False, "id"),
    ("voter_id", "name", 5, "ner", None, 80, ["elector's name", "name", "नाम"], False, "always"),
    ("voter_id", "father_husband_name", 4, "ner", None, 80, ["father", "husband", "relation", "पिता", "पति"], False, "never"),
    ("voter_id", "dob", 4, "regex_fuzzy", DATE, 80, ["date of birth", "dob", "age", "जन्म"], False, "dob"),
    ("voter_id", "gender", 2, "regex_fuzzy", GENDER_V, 75, ["gender", "sex", "लिंग"], False, "never"),
    ("voter_id", "address", 7, "ner", None, 80, ["address", "constituency", "part no", "पता", "विधान सभा"], False, "addr"),
]

#: (field, weight, pattern) of texts of unknown type, in order (fixed values).
UNIVERSAL = [("phone", 6, PHONE), ("email", 6, EMAIL), ("pan_pattern", 10, PAN), ("aadhaar_pattern", 10, AADHAAR), ("passport_pattern", 10, PASSPORT), ("date_pattern", 4, DATE)]

#: Keywords (one point each) and patterns (two points each) of each type (fixed values).
KEYWORDS = {
    "aadhaar": (["aadhaar", "uid", "uidai", "unique identification authority", "government of india", "enrolment", "enrollment", "आधार", "भारत सरकार", "नाम", "पता", "जन्म"], [r"\d{4}\s?\d{4}\s?\d{4}"]),
    "pan": (["permanent account number", "pan", "income tax", "department", "impot", "govt of india"], [r"[A-Z]{5}[0-9]{4}[A-Z]"]),
    "passport": (["passport", "republic of india", "nationality", "surname", "given name", "place of birth", "date of expiry"], [r"[A-PR-WY][1-9]\d{7}", r"P<IND"]),
    "driving_license": (["driving licence", "driving license", "transport", "licence no", "dl no", "blood group", "vehicle class"], [r"[A-Z]{2}\d{2}[A-Z]{0,2}\d{4,7}"]),
    "voter_id": (["election commission", "elector", "voter id", "epic", "photo identity card", "assembly constituency"], [r"[A-Z]{3}\d{7}"]),
}
MIN_TYPE_SCORE = 0.15

#: Contexts in which each profile requires a field (fixed values).
PROFILES = {
    "always": CONTEXTS,
    "id": ["identity_verification", "kyc_onboarding"],
    "dob": ["age_verification", "identity_verification", "kyc_onboarding"],
    "addr": ["address_proof", "kyc_onboarding"],
    "never": [],
}

#: Words that a person's name mostly does not consist of, and label words that are not part of a value (fixed values).
NAME_BLACKLIST = [
    "government", "india", "uidai", "aadhaar", "unique", "identification", "authority", "proof", "identity", "citizenship", "verification", "republic", "income", "tax", "department", "permanent", "account", "election", "commission", "transport", "passport", "driving", "licence", "license", "elector", "voter", "male", "female", "भारत", "सरकार", "आधार",
]
SKIP_WORDS = [
    "name", "dob", "date", "of", "birth", "gender", "sex", "address", "government", "india", "uid", "male", "female",
]

#: Fields that the entity groups of a model may fill (fixed values).
ENTITY_FIELDS = {
    "PER": ["name", "father_name", "father_husband_name", "father_spouse_name"],
    "PERSON": ["name", "father_name", "father_husband_name", "father_spouse_name"],
    "LOC": ["address", "place_of_birth", "place_of_issue"],
    "LOCATION": ["address", "place_of_birth"],
    "GPE": ["address", "place_of_birth"],
    "ORG": ["employer_name"],
    "DATE": ["dob", "date_of_expiry"],
}

#: Labels of contexts and methods (fixed values).
CONTEXT_LABELS = {"age_verification": "Age Verification", "identity_verification": "Identity Verification", "address_proof": "Address Proof", "kyc_onboarding": "KYC Onboarding", "general_upload": "General Upload"}
METHOD_LABELS = {"regex": "Regex", "ner": "NER", "keyword_anchor": "Keyword", "image": "Image"}

TYPE_LABELS = {"aadhaar": "Aadhaar Card", "pan": "PAN Card", "passport": "Passport", "driving_license": "Driving License", "voter_id": "Voter ID", "unknown": "Unknown"}


_SAMPLES = re.compile(
    r"\[A-Z\]\{(?P<capitals>\d+)\}|(?P<capital>\[A-Z\]|\[A-Za-z\])|(?P<space>\\s[?+])|\\d\{(?:\d+,)?(?P<digits>\d+)\}|(?P<digit>\\d)|(?P<mark>\\[/.-])|(?P<none>\\b|[()\[\]{}?*+|])"
)


def literal_form(pattern: str) -> str:
    """A sample of what a pattern matches, as approximate matching compares with it: zeros for digits, As for capitals."""

    def sample(m: re.Match) -> str:
        kind = m.lastgroup
        if kind in ("digits", "capitals"):
            return ("0" if kind == "digits" else "A") * int(m[kind])
        return {"none": "", "digit": "0", "capital": "A", "space": " ", "mark": "/"}[kind]

    return re.sub(_SAMPLES, sample, pattern).strip()


RULE_COLUMNS = "document_type string, field_name string, weight int, method string, pattern string, threshold int, anchors array<string>, always_redact boolean, required_in array<string>"


def rule_rows(rules: DataFrame | list[tuple]) -> list[tuple]:
    """Rules of a user as rows of ``RULE_COLUMNS``: a list, or a DataFrame in the order of its ``rule_pos``.

    A rule table is configuration, of as many rows as someone has written; it is read to the driver to become part of the plan."""
    if isinstance(rules, list):
        return rules
    ordered = rules.orderBy("rule_pos") if "rule_pos" in rules.columns else rules
    return [tuple(r) for r in ordered.select(*[c.split()[0] for c in RULE_COLUMNS.split(", ")]).collect()]


#: Labels of all types that a scan may have been given (fixed values).
DOCUMENT_LABELS = {**TYPE_LABELS, "ration_card": "Ration Card", "esic": "ESIC Card", "unknown": "Unknown Document"}


def default_rules() -> list[tuple]:
    return [(*r[:8], PROFILES[r[8]]) for r in FIELDS]


def field_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(default_rules())], "rule_pos int, " + RULE_COLUMNS)


def necessity_rows(rules: DataFrame | list[tuple] | None = None) -> list[tuple[str, str, str, bool]]:
    rows = default_rules() if rules is None else rule_rows(rules)
    return [(r[0], r[1], c, c in r[8]) for r, c in product(rows, CONTEXTS)]


def necessity(spark: SparkSession, rules: DataFrame | list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(necessity_rows(rules), "document_type string, field_name string, context string, required boolean")
