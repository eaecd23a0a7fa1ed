"""Personal data: base rules and bootstrapped contextual extraction.

Base rules find emails, IP addresses, cards and phones; a fifth kind, secrets, is seeded by long values that are assigned to a key, a token or
a password. These seeds start the bootstrap: every token with a digit or an ``@`` is an instance (a name assigned in the same token
is its context, as in ``id=4f``), and its lexical patterns are its shape together with the word before it, the two words before it, or the
word after it. Shapes keep how long numbers and hexadecimal strings are by classes. Spark scores the pattern-instance graph in rounds
until no pattern is added: a pattern's confidence for a kind is the mean score of its distinct instances, and an instance that no seed
covers takes the best confidence of its other patterns and counts as a seed for them. In the end, tokens that no base rule covers get
the kind of their most confident pattern.

Only DataFrame functions are used. Null and empty texts have no spans; spans are in code points, end exclusive; ties between
kinds go to the first as listed; repeated rows each get their row; extra columns are left alone. Work on a text is in proportion to its
length and, but for one part in BLOCK, to its identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ["email", "ip", "card", "phone"]
#: Kind that no base rule finds.
SECRET = "secret"
#: The base rules. Anchors at the start of a run and possessive counts keep them linear on long runs without
#: changing what they match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Tokens that may be identifiers.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What stands before a seed of a secret, and the seed itself.
ASSIGNED = r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|credential)s?[\"']?\s*[:=]+\s*[\"']?$"
SEED_SECRET = r"^(?=[^0-9]*[0-9])(?=.*\p{L})[\p{L}0-9+/_=-]{16,}$"
#: A name that a token assigns its value to.
NAME = r"^[^\w@+]*(?:[A-Za-z_.-]*[A-Za-z_-][\"']?[=:]+[^\w@+]*)?"
HEX = r"^(?=[^0-9]*[0-9])(?=[^A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{16,}$"
MIN_SEEDS, CONFIDENCE = 3, 0.8
#: Characters before and after a token in which its context words are sought.
CONTEXT = 64
#: Matches whose places are summed up together, and tokens that are compared with the spans near them together.
BLOCK, FEW = 256, 64
#: Patterns and identifiers are broadcast up to so many rows and bytes.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 100_000, 8 << 20


def _located(found: str, between: str) -> Column:
    """Matches with their places, from the columns of the matches and of what lies between them.

    Lengths are summed up block by block and the blocks are then moved to their places, as an array that grows by one element at
    a time would be copied once for each match. Both columns are read more than once, so that Spark keeps them as columns."""
    n = F.least(F.size(found), F.size(between))
    place = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))).alias("out"))

    def block(i: Column) -> Column:
        part = lambda c, first: F.slice(F.col(c), i * BLOCK + first, F.least(F.lit(BLOCK), n - i * BLOCK))
        words = F.zip_with(part(between, 1), part(between, 2), lambda b, a: F.struct(F.length(b).alias("gap"), F.right(b, F.lit(CONTEXT)).alias("before"), F.left(F.coalesce(a, F.lit("")), F.lit(CONTEXT)).alias("after")))
        pairs = F.zip_with(part(found, 1), words, lambda m, w: F.struct(m.alias("value"), w["gap"].alias("gap"), F.length(m).alias("n"), w["before"].alias("before"), w["after"].alias("after")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(place).alias("out")), step)

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block)
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{place}>").alias("out")), join, lambda acc: F.flatten(acc["out"]))


def _fits(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _fit_of(kind: str):
    return lambda x: _fits(kind, x["value"])


def _span_of(i: int):
    return lambda x: F.struct(F.lit(i).alias("kind_at"), x["start"].alias("start"), x["end"].alias("end"))


def _is_kind(i: int):
    return lambda s: s["kind_at"] == i


def scan_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, base (array of kind_at, start, end) and tokens (array of start, end, value, before, after), one row per row."""
    rules = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "token": TOKEN}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    at, digit = F.contains("t", F.lit("@")), F.col("t").rlike("[0-9]")
    rows = rows.select("id", "t", F.xxhash64("t").alias("key"), at.alias("has_at"), digit.alias("has_digit"), F.contains("t", F.lit("+")).alias("has_plus"))
    guard = {"email": F.col("has_at"), "ip": F.col("has_digit"), "card": F.col("has_digit"), "phone": F.col("has_plus") & F.col("has_digit"), "token": F.col("has_at") | F.col("has_digit")}
    none = F.array().cast("array<string>")
    rows = rows.select("id", "key", "t", *[F.when(guard[k], F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in rules.items()])
    rows = rows.select("id", "key", *[f"m_{k}" for k in rules], *[F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)).otherwise(none).alias(f"b_{k}") for k, p in rules.items()])
    rows = rows.select("id", "key", *[F.when(F.size(f"m_{k}") > 0, _located(f"m_{k}", f"b_{k}")).alias(f"l_{k}") for k in rules])
    empty = F.array().cast("array<struct<kind_at:int,start:int,end:int>>")
    spans = [F.coalesce(F.transform(F.filter(f"l_{k}", _fit_of(k)), _span_of(i)), empty) for i, k in enumerate(KINDS)]
    return rows.select("id", "key", F.concat(*spans).alias("base"), F.coalesce("l_token", F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")).alias("tokens"))


def _shape(value: Column) -> Column:
    """Coarse shape: runs of digits are one 9, runs with a letter one a, and of a chain of hyphens the first and last part remain.

    Numbers and hexadecimal strings in one run have a shape by their length, in classes."""
    n = F.length(value)
    coarse = value
    for pattern, new in ((r"^\+", ""), ("[0-9]++", "9"), (r"\p{L}++", "a"), ("9(?=a)|(?<=a)9", ""), ("a++", "a"), ("(?<=[9a])[-/()_]++[9a](?=[-/()_]++[9a])", "")):
        coarse = F.regexp_replace(coarse, pattern, new)
    digits = F.when(n < 4, "9{1}").when(n < 9, "9{4}").when(n < 13, "9{9}").when(n < 20, "9{13}").otherwise("9{20}")
    letters = F.concat(F.lit("x{"), F.floor(F.log2(n.cast("double"))).cast("string"), F.lit("}"))
    return F.when(value.rlike("^[0-9]+$"), digits).when(value.rlike(HEX), letters).otherwise(coarse)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_blocks(spans: Column) -> Column:
    """Array of blocks of ``spans``, each with the places from ``start`` to ``end`` that its spans lie in."""

    def block(i: Column) -> Column:
        own = F.slice(spans, i * BLOCK + 1, F.lit(BLOCK))
        return _once(own, lambda p: F.struct(F.array_min(F.transform(p, lambda x: x["start"])).alias("start"), F.array_max(F.transform(p, lambda x: x["end"])).alias("end"), p.alias("spans")))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), block)


def _with_cover(tokens: Column, blocks: Column) -> Column:
    """``tokens`` with ``seed``, the first kind of the base spans that overlap each.

    A few tokens at a time are compared with the spans near them only, which are sought among the ``blocks`` of spans first."""
    n = F.size(tokens)
    overlaps = lambda x, y: (x["start"] < y["end"]) & (x["end"] > y["start"])
    kind = lambda x, spans: F.array_min(F.transform(F.filter(spans, lambda s: overlaps(s, x)), lambda s: s["kind_at"]))

    def covered(p: Column) -> Column:
        whole = F.struct(F.get(p, F.lit(0))["start"].alias("start"), F.element_at(p, -1)["end"].alias("end"))
        near = _once(whole, lambda w: F.filter(F.flatten(F.transform(F.filter(blocks, lambda b: overlaps(b, w)), lambda b: b["spans"])), lambda s: overlaps(s, w)))
        return _once(near, lambda spans: F.transform(p, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "value", "before", "after")], kind(x, spans).alias("seed"))))

    part = lambda i: _once(F.slice(tokens, i * FEW + 1, F.lit(FEW)), covered)
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / FEW).cast("int")), part)))


def _instances(scanned: DataFrame) -> DataFrame:
    """One row per token and pattern: id, key, start, end, pattern, value, seed (kind of the rule that covers it, or null), base (whether
    a base rule does)."""
    rows = scanned.select("id", "key", "tokens", F.when(F.size("base") > 0, _in_blocks(F.col("base"))).otherwise(F.array()).alias("blocks"))
    tokens = rows.select("id", "key", F.explode_outer(_with_cover(F.col("tokens"), F.col("blocks"))).alias("x")).where("x is not null")
    lead = F.length(F.regexp_extract("x.value", NAME, 0))
    tail = F.length(F.regexp_extract(F.right("x.value", F.lit(CONTEXT)), r"[^\w@+]*$", 0))
    value = F.substring("x.value", lead + 1, F.greatest(F.length("x.value") - lead - tail, F.lit(0)))
    context = F.right(F.concat("x.before", F.left("x.value", lead)), F.lit(CONTEXT))
    rows = tokens.select("id", "key", (F.col("x.start") + lead).alias("start"), (F.col("x.end") - tail).alias("end"), context.alias("context"), F.col("x.after").alias("after"), value.alias("value"), F.col("x.seed").alias("cover"))
    secret = F.col("context").rlike(ASSIGNED) & F.col("value").rlike(SEED_SECRET)
    rows = rows.where("end > start").withColumns({"seed": F.coalesce("cover", F.when(secret, F.lit(len(KINDS)))), "shape": _shape(F.col("value"))})
    # words of the context without quotes, the sign of an assignment being a word
    words = F.filter(F.split(F.regexp_replace(F.lower("context"), r"([=:]+)", " $1 "), r"[\s\"']+"), lambda w: w != "")
    rows = rows.withColumns({"words": words, "next": F.lower(F.regexp_extract("after", r"^\s*(\S*)", 1))})
    one, two = F.coalesce(F.try_element_at("words", F.lit(-1)), F.lit("")), F.try_element_at("words", F.lit(-2))
    part = lambda tag, *c: F.concat_ws("\x00", F.lit(tag), *c, F.col("shape"))
    patterns = F.array(part("1", one), F.when(two.isNotNull(), part("2", two, one)), F.when(F.col("next") != "", part("+", F.col("next"))))
    rows = rows.select("id", "key", "start", "end", F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"), "value", "seed", F.col("cover").isNotNull().alias("base"))
    return rows.select("id", "key", "start", "end", F.explode("patterns").alias("pattern"), "value", "seed", "base")


def score_patterns(instances: DataFrame) -> DataFrame:
    """pattern, kind_at, confidence of the patterns with enough seeds and confidence."""
    edges = materialize(instances.groupBy("pattern", "value").agg(F.min("seed").alias("seed")))
    size = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    seeds = materialize(edges.where("seed is not null").select("value", F.col("seed").alias("kind_at")).distinct())
    hits = edges.select("pattern", "value").join(seeds, "value").select("pattern", "kind_at", F.lit(1.0).alias("score"))
    base = materialize(hits.groupBy("pattern", "kind_at").agg(F.sum("score").alias("s"), F.count("*").alias("seeds")))
    open_edges = materialize(edges.select("pattern", "value").join(seeds.select("value").distinct(), "value", "left_anti"))
    scores, trusted = base, None
    while True:
        rated = scores.groupBy("pattern", "kind_at").agg(F.sum("s").alias("s"), F.sum("seeds").alias("seeds")).join(size, "pattern").withColumn("confidence", F.col("s") / F.col("n"))
        added = rated.where((F.col("seeds") >= MIN_SEEDS) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "kind_at", "confidence")
        added = materialize(added if trusted is None else added.join(trusted, ["pattern", "kind_at"], "left_anti"))
        if trusted is not None and added.isEmpty():
            break
        trusted = added if trusted is None else materialize(trusted.unionByName(added))
        # an instance that is no seed takes the best confidence of its patterns, but no pattern is rated by itself
        found = materialize(open_edges.join(trusted, "pattern"))
        best = found.groupBy("value", "kind_at").agg(F.max(F.struct("confidence", "pattern")).alias("b"))
        second = found.join(best, ["value", "kind_at"]).where(F.col("pattern") != F.col("b.pattern")).groupBy("value", "kind_at").agg(F.max("confidence").alias("c"))
        best = best.join(second, ["value", "kind_at"], "left")
        given = open_edges.join(best, "value").withColumn("score", F.when(F.col("pattern") == F.col("b.pattern"), F.col("c")).otherwise(F.col("b.confidence"))).where("score is not null")
        scores = base.unionByName(given.groupBy("pattern", "kind_at").agg(F.sum("score").alias("s"), F.count("*").alias("seeds")))
    best = trusted.groupBy("pattern").agg(F.max(F.struct("confidence", (-F.col("kind_at")).alias("k"))).alias("b"))
    return best.select("pattern", (-F.col("b.k")).alias("kind_at"), F.col("b.confidence").alias("confidence"))


def _small(rows: DataFrame, size: Column) -> bool:
    """Whether the rows, of ``size`` bytes each, are few enough for a broadcast."""
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return got["n"] <= MAX_BROADCAST_ROWS and got["bytes"] <= MAX_BROADCAST_BYTES


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, key (hash of the text), base and spans, arrays of (kind_at, start, end) in order."""
    scanned = materialize(scan_rows(docs, id_col, text_col))
    instances = materialize(_instances(scanned))
    patterns = materialize(score_patterns(instances))
    few = F.broadcast(patterns) if _small(patterns, F.length("pattern") + 16) else patterns
    found = instances.where("not base").select("id", "key", "start", "end", "pattern").join(few, "pattern").groupBy("id", "key", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind_at")).alias("k"))).alias("b"))
    # seeds of secrets are spans by themselves
    own = instances.where((F.col("seed") == len(KINDS)) & ~F.col("base")).select("id", "key", F.col("seed").alias("kind_at"), "start", "end")
    found = found.select("id", "key", (-F.col("b.k")).alias("kind_at"), "start", "end")
    found = found.join(own.drop("kind_at").distinct().withColumnsRenamed({"id": "_i", "key": "_k", "start": "_s", "end": "_e"}), F.col("id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left_anti").unionByName(own)
    found = found.groupBy("id", "key").agg(F.collect_set(F.struct("kind_at", "start", "end")).alias("more"))
    found = materialize(found.withColumnRenamed("id", "id2").withColumnRenamed("key", "key2"))
    joined = scanned.join(F.broadcast(found) if _small(found, 24 + 16 * F.size("more")) else found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    return joined.select("id", "key", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind_at:int,start:int,end:int>>")))).alias("spans"))


def _apart(spans: Column) -> Column:
    """Sorted spans without those that begin within an earlier one, whose end then is the later of both; block by block."""
    kind = "array<struct<start:int,end:int,kind_at:int>>"
    n = F.size(spans)

    def add(acc: Column, s: Column) -> Column:
        joined = F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], s["end"]).alias("end"), acc["last"]["kind_at"].alias("kind_at"))
        inside = acc["last"].isNotNull() & (s["start"] < acc["last"]["end"])
        return F.struct(F.when(inside, joined).otherwise(s).alias("last"), F.when(inside | acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"])).alias("out"))

    def block(acc: Column, i: Column) -> Column:
        start = F.struct(acc["last"].alias("last"), F.array().cast(kind).alias("out"))
        part = F.aggregate(F.slice(spans, i * BLOCK + 1, F.least(F.lit(BLOCK), n - i * BLOCK)), start, add)
        return F.get(F.transform(F.array(part), lambda p: F.struct(p["last"].alias("last"), F.array_append(acc["out"], p["out"]).alias("out"))), F.lit(0))

    start = F.struct(F.lit(None).cast("struct<start:int,end:int,kind_at:int>").alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), start, block, lambda acc: F.concat(F.flatten(acc["out"]), F.array(acc["last"])))


def _replaced(text: Column, spans: Column, names: Column) -> Column:
    """``text`` with the spans, sorted and apart, replaced by names. The text is cut at every BLOCK spans first, as a cut goes through all before it."""
    n = F.size(spans)

    def block(i: Column) -> Column:
        part = F.slice(spans, i * BLOCK + 1, F.least(F.lit(BLOCK), n - i * BLOCK))
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i * BLOCK - 1)["end"])
        own = F.struct(part.alias("part"), begin.alias("begin"), F.substring(text, begin + 1, F.element_at(part, -1)["end"] - begin).alias("text"))

        def write(b: Column) -> Column:
            at = lambda j: F.when(j == 0, b["begin"]).otherwise(F.get(b["part"], j - 1)["end"])
            return F.array_join(F.transform(b["part"], lambda s, j: F.concat(F.substring(b["text"], at(j) - b["begin"] + 1, s["start"] - at(j)), F.get(names, s["kind_at"]))), "")

        return F.get(F.transform(F.array(own), write), F.lit(0))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block)
    return F.concat(F.array_join(blocks, ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; spans that overlap become one, of the kind of the first."""
    found = find_personal_data(docs, id_col, text_col).where(F.size("spans") > 0)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_at"].alias("kind_at"))))
    spans = found.select(F.col("id").alias("_id"), F.col("key").alias("_key"), ordered.alias("_all")).dropDuplicates(["_id", "_key"])
    spans = materialize(spans.select("_id", "_key", _apart(F.col("_all")).alias("_spans")))
    joined = docs.join(F.broadcast(spans) if _small(spans, 24 + 16 * F.size("_spans")) else spans, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_key")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, SECRET]])
    text = F.col(text_col)
    return joined.withColumn("_new", F.when(F.col("_spans").isNotNull(), _replaced(text, F.col("_spans"), names)).otherwise(text)).select(*[F.col("_new").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, SECRET]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_at"]), s["start"], s["end"])), ",")


def op3_pii(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
