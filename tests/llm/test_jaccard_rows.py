"""The n-gram join row by row: identifiers with several texts, classes that collide, signatures that are left out."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilmark.llm import jaccard_join
from veilmark.llm.common import Scratch


def plain_components(rows):
    """(doc_id, set size, smallest doc_id reachable) of each row, by comparing all pairs of rows."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)].append(doc)
    return Counter((doc, len(sets[i]), min(least[top(i)], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def near(rng, n_words, changes):
    base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    other = list(base)
    for _ in range(changes):
        other[rng.randrange(n_words)] = f"x{rng.randrange(10**6)}"
    return " ".join(base), " ".join(other)


def mixed_rows(seed=3):
    rng, rows = random.Random(seed), []
    for g in range(60):  # doc 4g has two texts, each with a near copy under a larger or smaller identifier
        (a, a2), (b, b2) = near(rng, 60, 1), near(rng, 60, 1)
        rows += [(4 * g + 1, a), (4 * g + 1, b), (4 * g, a2), (4 * g + 2, b2)]
    for _ in range(40):
        a, b = near(rng, rng.randrange(1, 40), rng.randrange(0, 3))
        rows += [(rng.randrange(1000, 1050), a), (rng.randrange(1000, 1050), b)]
    a, b = near(rng, 80, 1)
    rows += [(None, a), (None, b), (None, "only null one two three four"), (None, "only null one two three four"), (None, None), (5, None), (5, ""), (5, " "), (5, ""), (2000, a)]
    return rows + rows[:10]


def test_an_identifier_with_several_texts(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, class int, key string")
    got = Counter(map(tuple, jaccard_join.op9_jaccard_join(docs).collect()))
    assert got == plain_components(rows)


def test_different_sets_of_one_class_are_told_apart(spark, monkeypatch):
    """With classes of four bits nearly all classes hold several sets."""
    plain = jaccard_join.set_classes

    def narrow(owner, gram, n):
        size, cls, check = plain(owner, gram, n)
        return size, cls & 15, check

    rows = mixed_rows(9)[200:]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    keyed = docs.select("doc_id", *jaccard_join.row_key(), "text")
    # executors run the module's own function, so the classes are narrowed in its result
    whole = jaccard_join.classify_sets
    monkeypatch.setattr(jaccard_join, "classify_sets", lambda r: whole(r).withColumn("class", F.col("class").bitwiseAND(F.lit(15))))

    def emitted(texts):
        named = "class" in texts.columns

        def run(batches):
            for batch in batches:
                owner, gram = jaccard_join.shingle_sets(batch.column(0).to_pylist())
                n, cls, _ = narrow(owner, gram, batch.num_rows)
                cls = batch.column(1).to_numpy() if named else cls
                of, sig = jaccard_join.signatures(owner, gram, n)
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(cls[of], pa.int64())], names=["sig", "class"])

        return texts.mapInArrow(run, "sig long, class long")

    monkeypatch.setattr(jaccard_join, "signature_rows", emitted)
    with Scratch() as scratch:
        found = jaccard_join.linked_rows(keyed, scratch).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == plain_components(rows)


def test_linked_sets_share_a_signature():
    """Whatever signatures a set leaves out, its partners at 0.8 and above share one with it."""
    rng = np.random.default_rng(4)
    few = many = 0
    for size in [*range(1, 60), 75, 100, 150, 300, 700, 2000]:
        for _ in range(6):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            most = size // 5 if rng.random() < 0.7 else size // 9
            cut = int(rng.integers(0, most + 1))
            more = int(rng.integers(0, most - cut + 1))
            b = np.unique(np.concatenate((a[cut:], rng.integers(0, 1 << 63, more, dtype=np.uint64))))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            owner = np.repeat([0, 1], [len(a), len(b)])
            of, sig = jaccard_join.signatures(owner, np.concatenate((a, b)), np.array([len(a), len(b)]))
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (size, cut, more)
            few += len(sig)
            many += 1
    assert many > 200


def test_elements_that_one_part_would_hold():
    """Partitions without end come to parts of one element each."""
    gram = np.arange(40, dtype=np.uint64) * np.uint64(7919)
    old = jaccard_join.MOST_PARTS
    try:
        jaccard_join.MOST_PARTS = 1
        of, sig = jaccard_join.signatures(np.zeros(40, dtype=np.int64), gram, np.array([40]))
    finally:
        jaccard_join.MOST_PARTS = old
    assert len(sig) and len(np.unique(sig)) == len(sig)


def test_rows_of_a_hot_bucket(spark):
    """100,000 classes that do not link meet two blocks at a time in less than a million rows."""
    rows = spark.range(100_000).select(F.lit(7).alias("sig"), F.col("id").alias("class"))
    parts = int(np.ceil(100_000 / jaccard_join.BUCKET))
    met = jaccard_join.bucket_blocks(rows.withColumn("parts", F.lit(parts)))
    assert met.count() < 1_000_000
    tasks = met.groupBy("lo", "hi").count().collect()
    assert len(tasks) == parts * (parts + 1) // 2 and max(r["count"] for r in tasks) < 2.2 * jaccard_join.BUCKET


def test_scratch_tables_are_removed(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in folder.glob("*")}
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string")
    found = jaccard_join.link_documents(docs)
    assert len({p.name for p in folder.glob("*")} - before) == 1 and found.count() == docs.count()


def test_buckets_of_the_same_classes_are_gone_through_once(spark, monkeypatch):
    """Sets that nearly link agree on many signatures; their pairs are compared, and their bitmaps carried, once. Bitmaps lie in one table at a time."""
    rng, rows = random.Random(8), []
    for g in range(30):
        a, b = near(rng, 200, 9)
        c, d = near(rng, 200, 1)
        rows += [(4 * g, a), (4 * g + 1, b), (4 * g + 2, c), (4 * g + 3, d)]
    seen, wide = [], []
    shared, crossing = jaccard_join.shared_buckets, jaccard_join.crossing_pairs

    def met(emitted):
        wide.append(sum("cells" in df.columns for df, _ in Scratch.open[-1].tables))
        return shared(emitted)

    def gone_through(buckets, nearest):
        members = defaultdict(set)
        for r in buckets.select("sig", "class").collect():
            members[r["sig"]].add(r["class"])
        seen.append(Counter(frozenset(m) for m in members.values()))
        return crossing(buckets, nearest)

    monkeypatch.setattr(jaccard_join, "shared_buckets", met)
    monkeypatch.setattr(jaccard_join, "crossing_pairs", gone_through)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.op9_jaccard_join(docs).collect())) == plain_components(rows)
    assert seen[0] and max(seen[0].values()) == 1 and wide == [1]
