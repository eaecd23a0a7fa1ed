"""N-gram Jaccard join with PartEnum signatures, and the groups of documents that it links.

A document's set holds the hashes of its distinct five-word shingles. Two sets of sizes ``a`` and ``b`` link when
their Jaccard similarity is at least 0.8; they then differ in at most ``(a + b) / 9`` elements.

Signatures. Sizes are cut into bands. Within a band the domain of elements is partitioned by a hash into more
parts than sets of the band that link may differ in, so that linked sets agree on some part; a set's signature for a part is
the hash of its elements there. In bands of small sets the parts are half as many, each cut in three, and every subset of two of the
three gives a signature: linked sets differ by at most one element in some part and agree on a subset there. Empty projections give no
signature: as long as one of two linked sets has elements in more parts than they may differ in, they still agree on
a non-empty one. A set for which that fails also emits the signatures of finer partitions, up to one element for each part, where
it cannot fail; two sets meet at the coarser of their last partitions. A set emits for every band that a larger partner may be in.
Where linked sets agree on several parts, a set leaves out so many of its largest signatures that the smallest common one is kept by both.
So linked sets always share a signature; no bucket is capped.

Work in a bucket. Equal sets, told apart by 128 bits, are one class and meet once; a class takes part with the text of one of its rows. Each class is first verified against the smallest class of a
bucket, and components are formed. Then only buckets that still hold several components are gone through for pairs across components,
those of many classes in blocks that meet two by two in tasks of their own. A set's bitmap has a bit for the parity of the elements in
each of its cells; the number of bits in which two bitmaps differ cannot exceed the number of differing elements and is close to it, so
that pairs which do not link are ruled out before they are emitted. A pair that shares several buckets is emitted in the first only,
as far as the few smallest signatures that each class brings along tell. The nearest pair of a set and another component is verified first;
where it links them, the rest need not be looked at. Every pair that is emitted is verified on the whole texts, once.

Null and empty texts have empty sets and link with nothing. Every row is a document: repeated rows get a row each, and an identifier that
stands with several texts takes part with each of them. A null identifier takes part, but cannot name a component; a component without
any other has a null one. Elements are hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, connected_components, give_back, joined_components, materialize

SHINGLE = 5
BLOCK_BYTES = 500_000
#: Sizes of a band lie within this ratio; up to SMALL, parts are cut in three.
RATIO, SMALL, SLACK = 1.5, 48, 1.2
#: Bitmaps have four bits or more for each element up to MANY_BITS bits, one or more beyond, LEAST_BITS at least, a power of two. Unrelated
#: sets then lie farther apart than linked ones at every size.
LEAST_BITS, MANY_BITS, BITS_PER_ELEMENT = 512, 8192, 4
#: Signatures that a class brings along, the smallest first, to tell whether a pair has met in an earlier bucket.
FIRST_SIGNATURES = 16
#: Rows of four numbers are broadcast up to this number (8 MB); more are joined by a shuffle.
MAX_BROADCAST_ROWS = 250_000
#: Members that one task verifies against a leader before the leader is copied to another.
MEMBERS = 500
#: Classes, and bytes of their bitmaps, of a bucket in one block; larger buckets are cut into blocks that meet two by two.
BUCKET, BUCKET_BYTES = 12_000, 8 << 20
#: Parts up to which elements are dealt to parts; beyond it every element is a part.
MOST_PARTS = 1 << 31
#: Classes of a bucket up to which the buckets at hand are compared together, and bytes of bitmaps compared at once.
FEW, COMPARED_BYTES = 32, 1 << 22

_u = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + _u(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def _sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, begins) if len(begins) else np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts: index of the text and hash, sorted by both."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]).lower(), dtype=np.uint8)  # bytes.lower changes A-Z only
    text_starts = np.zeros(len(raw), dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw[:-1]], out=text_starts[1:])
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate(([False], inside)).astype(np.int8))
    begins = np.flatnonzero(edge == 1)
    if not len(begins):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(np.diff(np.concatenate((inside, [False])).astype(np.int8)) == -1) + 1
    lengths = ends - begins
    # only bytes of words are hashed, each by its value and its place in the word
    since = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
    table = _mix(np.arange(256, dtype=np.uint64), 1)
    word = _mix(_sums(table[data[inside]] * power[since], np.cumsum(lengths) - lengths), 2)
    of = np.searchsorted(text_starts, begins, side="right") - 1
    per_text = np.bincount(of, minlength=len(raw))
    k = SHINGLE
    if len(word) >= k:
        gram = sum(word[j : len(word) - k + 1 + j] * _u(2 * j * j + 0x5851F42D4C957F2D + 2 * j) for j in range(k))
        same = of[: len(word) - k + 1] == of[k - 1 :]
        gram, owner = gram[same], of[: len(word) - k + 1][same]
    else:
        gram, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first = np.cumsum(per_text) - per_text
    short = np.flatnonzero((per_text > 0) & (per_text < k))
    if len(short):  # fewer words than a shingle: the whole sequence is one
        whole = np.array([int(sum(int(word[first[i] + j]) * (2 * j * j + 0x5851F42D4C957F2D + 2 * j) for j in range(per_text[i])) + int(per_text[i])) & 0xFFFFFFFFFFFFFFFF for i in short], dtype=np.uint64)
        gram, owner = np.concatenate((gram, whole)), np.concatenate((owner, short))
    gram = _mix(gram, 3)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], gram[new]


def set_classes(owner: np.ndarray, gram: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each text's set, and two hashes of the set: its class and what tells sets of one class apart."""
    n = np.bincount(owner, minlength=n_texts)
    held = np.flatnonzero(n)
    out = []
    for seed in (4, 12):
        total = np.zeros(n_texts, dtype=np.uint64)
        total[held] = _sums(_mix(gram, seed), (np.cumsum(n) - n)[held])
        out.append(_mix(total, seed + 1).view(np.int64))
    return n, *out


def bitmaps(owner: np.ndarray, gram: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """Parity of the elements in each cell for each set; null for empty sets. A smaller bitmap is a larger one folded by exclusive or."""
    bounds = np.concatenate(([0], np.cumsum(n)))
    place = _mix(gram, 11)
    out: list[bytes | None] = []
    for i, size in enumerate(n.tolist()):
        if not size:
            out.append(None)
            continue
        bits = 1 << (max(LEAST_BITS, min(BITS_PER_ELEMENT * size, MANY_BITS), size) - 1).bit_length()
        cell = (place[bounds[i] : bounds[i + 1]] & _u(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def bits_apart(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits between each row of ``many`` and ``one``, which may be shorter."""
    if many.shape[1] > len(one):
        many = np.bitwise_xor.reduce(many.reshape(len(many), -1, len(one)), axis=1)
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


def pairs_apart(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Differing bits between the bitmaps of each row of ``longer`` and the same row of ``shorter``."""
    if longer.shape[1] > shorter.shape[1]:
        longer = np.bitwise_xor.reduce(longer.reshape(len(longer), -1, shorter.shape[1]), axis=1)
    return np.bitwise_count(longer ^ shorter).sum(axis=1, dtype=np.int64)


def bands() -> np.ndarray:
    """Largest size of each band."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    return np.array(edges, dtype=np.int64)


_BANDS = bands()


def _smallest(owner: np.ndarray, sig: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of each set without the ``spare`` largest."""
    order = np.lexsort((sig, owner))
    owner, sig = owner[order], sig[order]
    left = np.bincount(owner, minlength=len(spare))
    place = np.arange(len(owner)) - (np.cumsum(left) - left)[owner]
    kept = place < (left - spare)[owner]
    return owner[kept], sig[kept]


def signatures(owner: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and signature, for every signature of every set."""
    out_owner, out_sig = [], []
    low, high = np.searchsorted(_BANDS, n), np.searchsorted(_BANDS, n * 5 // 4)
    place, spread = _mix(gram, 6) >> _u(32), _mix(gram, 7)
    for shift in range(int((high - low).max(initial=0)) + 1):
        band = low + shift
        active = (n > 0) & (band <= high)
        upper = _BANDS[np.minimum(band, len(_BANDS) - 1)]
        differ = (n + np.minimum(upper, n * 5 // 4)) // 9  # most elements in which a partner of this band differs
        most = 2 * upper // 9
        level = 0
        while active.any():
            some = active[owner]
            o, p, s, e = owner[some], place[some], spread[some], gram[some]
            cut = (upper <= SMALL) & (level == 0)
            parts = np.where(cut, np.ceil(1.3 * (most // 2 + 1)), np.ceil(SLACK * (most + 1)) * 4.0**level)
            single = parts > MOST_PARTS
            parts = np.where(single, 1, parts).astype(np.int64)
            part = np.where(single[o], e, (p * parts[o].astype(np.uint64)) >> _u(32))
            name = _mix(part + (band[o].astype(np.uint64) << _u(40)) + (_u(level) << _u(56)), 8)
            good = np.zeros(len(n), dtype=np.int64)
            own_owner, own_sig = [], []
            plain = ~cut[o]
            if plain.any():
                key = np.flatnonzero(plain)[np.lexsort((part[plain], o[plain]))]
                begin = np.flatnonzero(np.concatenate(([True], (part[key][1:] != part[key][:-1]) | (o[key][1:] != o[key][:-1]))))
                own_owner.append(o[key][begin])
                own_sig.append(_mix(_sums(s[key], begin) + name[key][begin], 9))
                good += np.bincount(own_owner[-1], minlength=len(n))
            if not plain.all():
                third = ((_mix(s[~plain], 10) >> _u(33)) % _u(3)).astype(np.int64)
                oo, pp, ss, nn = o[~plain], part[~plain], s[~plain], name[~plain]
                occupied = np.zeros(0, dtype=np.int64)
                for left_out in range(3):
                    at = np.flatnonzero(third != left_out)
                    key = at[np.lexsort((pp[at], oo[at]))]
                    if not len(key):
                        continue
                    begin = np.flatnonzero(np.concatenate(([True], (pp[key][1:] != pp[key][:-1]) | (oo[key][1:] != oo[key][:-1]))))
                    own_owner.append(oo[key][begin])
                    own_sig.append(_mix(_sums(ss[key], begin) + nn[key][begin] + _u(left_out + 1), 9))
                    occupied = np.concatenate((occupied, (oo[key][begin] << 32) + pp[key][begin].astype(np.int64)))
                # a part counts when all three of its subsets are non-empty
                where, times = np.unique(occupied, return_counts=True)
                good += np.bincount(where[times == 3] >> 32, minlength=len(n))
            # a linked set agrees on so many parts at least; of the signatures all but one of them may be left out, from the largest on
            agreed = good - np.where(cut, differ // 2, differ)
            found = _smallest(np.concatenate(own_owner), np.concatenate(own_sig), np.maximum(agreed - 1, 0))
            out_owner.append(found[0])
            out_sig.append(found[1])
            active &= (agreed < 1) & ~single
            level += 1
    if not out_owner:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_owner), np.concatenate(out_sig).view(np.int64)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BLOCK_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t or "") + 1
    if begin < len(texts):
        yield begin, len(texts)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``doc`` and ``key``, which tell a row by its identifier and a digest of its text, be they null or not."""
    number = F.col(id_col).cast("long")
    digest = F.coalesce(F.unhex(F.md5(F.col(text_col))), F.lit(b""))
    return [F.coalesce(number, F.lit(0)).alias("doc"), F.when(number.isNull(), F.concat(digest, F.lit(b"-"))).otherwise(digest).alias("key")]


def classify_sets(rows: DataFrame) -> DataFrame:
    """doc_id, doc, key, n_shingles, class and check (null for an empty set) and cells (the bitmap of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in _blocks(texts):
                owner, gram = shingle_sets(texts[a:b])
                n, cls, check = set_classes(owner, gram, b - a)
                empty = n == 0
                columns = [pa.array(n, pa.int64()), pa.array(cls, pa.int64(), mask=empty), pa.array(check, pa.int64(), mask=empty), pa.array(bitmaps(owner, gram, n), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), *columns], names=["doc_id", "doc", "key", "n_shingles", "class", "check", "cells"])

    return rows.mapInArrow(lambda batches: give_back(run(batches)), "doc_id long, doc long, key binary, n_shingles long, class long, check long, cells binary")


def signature_rows(texts: DataFrame) -> DataFrame:
    """sig, class of ``texts`` (text and, to be given another class, class); a task emits a class once."""
    named = "class" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _blocks(texts):
                owner, gram = shingle_sets(texts[a:b])
                n, cls, _ = set_classes(owner, gram, b - a)
                if named:
                    cls = batch.column(1).slice(a, b - a).to_numpy()
                fresh = np.zeros(b - a, dtype=bool)
                for i, c in enumerate(cls.tolist()):
                    if n[i] and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                keep = fresh[owner]
                of, sig = signatures(owner[keep], gram[keep], np.where(fresh, n, 0))
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(cls[of], pa.int64())], names=["sig", "class"])

    return texts.mapInArrow(lambda batches: give_back(run(batches)), "sig long, class long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """sig, class, leader: the buckets with more than one class, and the smallest class of each.

    Rows come sorted, so a task keeps the last row only, however large a bucket is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig, last_cls, leader, rank = None, 0, 0, 0
        for batch in batches:
            sig, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            new_sig = np.concatenate(([last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]))
            fresh = new_sig | np.concatenate(([cls[0] != last_cls], cls[1:] != cls[:-1]))
            last_sig, last_cls = sig[-1], cls[-1]
            sig, cls, new_sig = sig[fresh], cls[fresh], new_sig[fresh]
            if not len(sig):
                continue
            # place in the bucket, and the bucket's first class; the bucket that goes on from the last batch has its own so far
            group = np.cumsum(new_sig)
            begin = np.flatnonzero(new_sig)
            place = np.arange(len(sig)) - np.concatenate(([-rank - 1], begin))[group]
            lead = np.concatenate(([leader], cls[begin]))[group]
            leader, rank = lead[-1], int(place[-1])
            member, second = place > 0, place == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x), pa.int64()) for x in ((sig[member], sig[second]), (cls[member], lead[second]), (lead[member], lead[second]))],
                names=["sig", "class", "leader"],
            )

    return rows.repartition("sig").sortWithinPartitions("sig", "class").mapInArrow(lambda batches: give_back(run(batches)), "sig long, class long, leader long")


def verify(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets link, compared on the whole texts that stand for them."""
    leaders = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(leaders, "a").select(F.col("b").alias("class"), F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    own = leaders.select(F.col("a").alias("class"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    links = materialize(members.unionByName(own).join(classes.select("class", "doc", "key"), "class"))
    small = links.count() <= MAX_BROADCAST_ROWS
    met = rows.select("doc", "key", "text").join(F.broadcast(links) if small else links, ["doc", "key"]).select("lead", "salt", "member", "class", "text")
    met = met.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            lead, member, doc, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            found = []
            for a, b in _blocks(texts):
                owner, gram = shingle_sets(texts[a:b])
                bounds = np.searchsorted(owner, np.arange(b - a + 1))
                for i in range(b - a):
                    own_set = gram[bounds[i] : bounds[i + 1]]
                    if not member[a + i]:
                        now, base = lead[a + i], own_set.copy()
                    elif now == lead[a + i] and len(base) and len(own_set):
                        at = np.minimum(np.searchsorted(base, own_set), len(base) - 1)
                        both = int((base[at] == own_set).sum())
                        if 100 * both >= 80 * (len(base) + len(own_set) - both):
                            found.append((now, doc[a + i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return met.mapInArrow(lambda batches: give_back(run(batches)), "a long, b long").distinct()


def _group_starts(table: pa.Table) -> np.ndarray:
    """Where the rows of the next two blocks begin, in a table sorted by sig, lo and hi."""
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = False
    for name in ("sig", "lo", "hi"):
        c = table[name].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def distinct_buckets(buckets: DataFrame) -> DataFrame:
    """sig and parts of one of the ``buckets`` (sig, parts, size, x, y) of the same classes, that with the smallest sig.

    Sets that nearly link agree on many signatures, so that the same classes meet in many buckets; their pairs are the same in each.
    Classes are told by their number and 128 bits (x and y)."""
    return buckets.groupBy("size", "x", "y").agg(F.min("sig").alias("sig"), F.max("parts").alias("parts")).select("sig", "parts")


def bucket_blocks(buckets: DataFrame) -> DataFrame:
    """``buckets`` (sig, class, parts and more) with lo, hi and block: which two blocks of its bucket a row meets in a task.

    A bucket of one part is one block. In a bucket of several, classes are dealt to blocks by a hash, and every two blocks meet, so
    that every two classes still do; a task never gets more than two blocks of one bucket at once."""
    block = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    rows = buckets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "parts")


def _matrix(cells: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The bitmaps of ``rows``, all of ``width`` bytes, as rows of 64-bit words."""
    starts = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset + rows].astype(np.int64)
    data = np.frombuffer(cells.buffers()[2], np.uint8)
    return data[starts[:, None] + np.arange(width)].view(np.uint64)


def crossing_pairs(buckets: DataFrame, nearest: bool) -> DataFrame:
    """Pairs ``a, b`` of classes in one bucket that lie in different components and that their bitmaps allow.

    ``buckets`` has sig, class, parts, comp, n, cells, firsts. With ``nearest``, of the pairs of a class and a component in
    two blocks of a bucket only the one with the nearest bitmaps; ``sig`` of further rows, without a pair, names the buckets that have more.
    Rows come sorted, so a task holds the two blocks at hand only."""

    def meet(table: pa.Table, more: set[int]) -> list[tuple[int, int]]:
        sig, rep, comp, n, block, lo, hi = (table[c].to_numpy() for c in ("sig", "class", "comp", "n", "block", "lo", "hi"))
        cells, firsts = table["cells"].combine_chunks(), table["firsts"].combine_chunks()
        width = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1])
        out: list[tuple[int, int]] = []
        known: dict[int, set[int]] = {}

        def add(i: int, j: int) -> None:
            for k in (i, j):
                if k not in known:
                    known[k] = set(firsts[k].as_py())
            if min(known[i] & known[j], default=sig[i]) >= sig[i]:  # else they have met in an earlier bucket
                out.append((min(int(rep[i]), int(rep[j])), max(int(rep[i]), int(rep[j]))))

        begin = _group_starts(table)
        size = np.diff(np.append(begin, len(rep)))
        # buckets of a few classes, which are the most, all at once
        few = [np.zeros((2, 0), dtype=np.int64)]
        for k in np.unique(size[(size > 1) & (size <= FEW)]).tolist():
            few.append((begin[size == k][:, None] + np.array(np.triu_indices(k, 1))[:, None, :]).reshape(2, -1))
        left, right = np.concatenate(few, axis=1)
        fit = (comp[left] != comp[right]) & (n[right] <= n[left] * 5 // 4) & ((lo[left] == hi[left]) | (block[left] != block[right]))
        left, right = left[fit], right[fit]
        apart = np.zeros(len(left), dtype=np.int64)
        shape = width[left].astype(np.int64) << 32 | width[right]
        for w in np.unique(shape).tolist():
            same = np.flatnonzero(shape == w)
            step = max(COMPARED_BYTES // (w & 0xFFFFFFFF), 1)
            for k in range(0, len(same), step):
                at = same[k : k + step]
                apart[at] = pairs_apart(_matrix(cells, right[at], w & 0xFFFFFFFF), _matrix(cells, left[at], w >> 32))
        fit = apart <= (n[left] + n[right]) // 9
        left, right, apart = left[fit], right[fit], apart[fit]
        if nearest and len(left):
            order = np.lexsort((right, apart, comp[right], left))
            left, right = left[order], right[order]
            behind = np.concatenate(([False], (left[1:] == left[:-1]) & (comp[right[1:]] == comp[right[:-1]])))
            more.update(sig[left[behind]].tolist())
            left, right = left[~behind], right[~behind]
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            add(i, j)
        large = size > FEW
        for x, y in zip(begin[large].tolist(), (begin + size)[large].tolist(), strict=True):
            if (comp[x:y] == comp[x]).all():
                continue
            across = lo[x] != hi[x]  # two blocks: those of one block meet elsewhere
            # sorted by size, so bitmaps of one width follow each other
            widths = width[x:y]
            own = {w: (x + int(np.searchsorted(widths, w)), _matrix(cells, x + np.flatnonzero(widths == w), w)) for w in np.unique(widths).tolist()}
            for i in range(x, y - 1):
                end = x + int(np.searchsorted(n[x:y], n[i] * 5 // 4, side="right"))  # no larger partner links
                first, rows = own[int(width[i])]
                mine = rows[i - first]
                near: dict[int, tuple[int, int]] = {}
                for w, (first, rows) in own.items():
                    a, b = max(i + 1, first), min(end, first + len(rows))
                    if w < width[i] or a >= b:
                        continue
                    fit = comp[a:b] != comp[i]
                    if across:
                        fit &= block[a:b] != block[i]
                    js = a + np.flatnonzero(fit)
                    if not len(js):
                        continue
                    apart = bits_apart(rows[js - first], mine)
                    fits = apart <= (n[js] + n[i]) // 9
                    for j, d in zip(js[fits].tolist(), apart[fits].tolist(), strict=True):
                        if not nearest:
                            add(i, j)
                            continue
                        if int(comp[j]) in near:
                            more.add(int(sig[i]))
                        if d < near.get(int(comp[j]), (1 << 60, 0))[0]:
                            near[int(comp[j])] = (d, j)
                for _, j in near.values():
                    add(i, j)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the two blocks that have not ended
        for batch in chain(batches, [None]):
            if batch is None:
                table, held = held, None
            else:
                table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                table = table.combine_chunks()
                last = int(_group_starts(table)[-1]) if table.num_rows else 0
                held, table = table.slice(last), table.slice(0, last)
            if table is None or not table.num_rows:
                continue
            more: set[int] = set()
            out = meet(table, more)
            columns = [[*(p[0] for p in out), *[None] * len(more)], [*(p[1] for p in out), *[None] * len(more)], [*[None] * len(out), *more]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "sig"])

    rows = bucket_blocks(buckets).select("sig", "lo", "hi", "block", "class", "comp", "n", "cells", F.filter("firsts", lambda x: x < F.col("sig")).alias("firsts")).repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "n")
    return rows.mapInArrow(lambda batches: give_back(run(batches)), "a long, b long, sig long").distinct()


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    bound_batches(docs.sparkSession)
    with Scratch() as scratch:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
        return scratch.result(linked_rows(rows, scratch).select("doc_id", "n_shingles", "component_id"))


def linked_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, doc, key, n_shingles, component (null for an empty set) and component_id of ``rows`` (doc_id, doc, key, text); see ``row_key``."""
    sets = materialize(classify_sets(rows))
    wide = [sets]

    def described() -> DataFrame:
        lists = [F.min(F.struct("doc", "key")).alias("row"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.max("cells").alias("cells"), F.min("check").alias("check"), F.max("check").alias("other")]
        return materialize(sets.where("class is not null").groupBy("class").agg(*lists).select("class", "row.*", "least", "n", "cells", "check", "other"))

    classes = described()
    emitted = signature_rows(rows.select("text"))
    twins = classes.where("check <> other").select("class", F.col("check").alias("first"))
    if not twins.isEmpty():  # different sets with one class: all but the first get a class of their own
        apart = sets.join(twins, "class", "left").withColumn("own", F.when(F.col("check") != F.col("first"), F.xxhash64("class", "check")))
        sets = materialize(apart.withColumn("class", F.coalesce("own", "class")).drop("first"))
        wide.append(sets)
        named = materialize(sets.where("own is not null").select("doc", "key", "class").distinct())
        sets = sets.drop("own")
        wide.append(classes)
        classes = described()
        emitted = emitted.unionByName(signature_rows(rows.join(named, ["doc", "key"]).select("text", "class")))
    # bitmaps are kept with the classes only, and then with those that meet others only
    sets = materialize(sets.drop("check", "cells"))
    for table in wide:
        scratch.drop(table)
    buckets = materialize(shared_buckets(emitted))
    classes_met = materialize(buckets.select("class").distinct().join(classes.select("class", "doc", "key", "n", "cells"), "class"))
    leasts = materialize(classes.select("class", "least"))
    scratch.drop(classes)
    # a class meets the leader with which it shares most buckets
    star = buckets.where("class <> leader").groupBy("class", "leader").agg(F.count("*").alias("n"))
    pairs = materialize(star.groupBy("class").agg(F.max_by("leader", F.struct("n", "leader")).alias("a")).select("a", F.col("class").alias("b")))
    links = materialize(verify(pairs, classes_met, rows))
    comps = materialize(connected_components(links))
    # what the leaders have not joined: first the nearest pairs, then all that still cross and have not been verified
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for nearest in (True, False):
        labelled = classes_met.join(comps.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("component", "class")).select("class", "comp", "n", "cells")
        members = buckets.select("sig", "class").join(labelled.select("class", "comp", F.length("cells").alias("bytes")), "class")
        parts = F.ceil(F.greatest(F.count("*") / BUCKET, F.sum("bytes") / BUCKET_BYTES)).cast("int")
        told = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")]
        mixed = members.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), parts.alias("parts"), *told).where("lo <> hi")
        met = materialize(buckets.select("sig", "class").join(distinct_buckets(mixed), "sig"))
        scratch.drop(buckets)
        buckets = met
        firsts = buckets.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST_SIGNATURES).alias("firsts"))
        found = materialize(crossing_pairs(buckets.join(labelled.join(firsts, "class"), "class"), nearest))
        # only buckets in which the nearest pairs hide others are gone through again
        again = found.where("sig is not null").select("sig")
        met = materialize(buckets.join(F.broadcast(again) if again.count() <= MAX_BROADCAST_ROWS else again, "sig", "left_semi"))
        scratch.drop(buckets)
        buckets = met
        crossing = materialize(found.where("sig is null").select("a", "b").join(tried, ["a", "b"], "left_anti"))
        if crossing.isEmpty():
            continue
        tried = tried.unionByName(crossing)
        more = materialize(verify(crossing, classes_met, rows))
        if not more.isEmpty():
            comps = materialize(joined_components(comps, more))
    # the smallest identifier of each component that links formed
    of = comps.withColumnRenamed("node", "class").join(leasts, "class")
    named = of.join(of.groupBy("component").agg(F.min("least").alias("low")), "component").select("class", "component", "low")
    own = leasts.join(named, "class", "left")
    own = own.select("class", F.coalesce("component", "class").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("low")).alias("least"))
    joined = sets.join(own, "class", "left")
    return joined.select("doc_id", "doc", "key", "n_shingles", "component", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op9_jaccard_join(docs: DataFrame) -> DataFrame:
    return link_documents(docs)
