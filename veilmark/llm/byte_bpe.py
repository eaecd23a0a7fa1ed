"""Byte-level BPE encoding and decoding by merge replay over a vocabulary.

A task gathers the distinct pieces of many texts, lays their bytes out as tokens in one row, and keeps an inverted index from
each token pair, named by the rank of its merge, to the places where it stands. Merges are applied in the order of their ranks, each at
all its places at once; only the neighbours of a place change, and only their pairs are looked up anew and enter the index. Where a
merge makes room for one of a lower rank (which few vocabularies allow), the later places of that piece wait until the lower one is
done. So the result is that of merging each piece by itself, lowest rank and leftmost place first.

Encoding adds ``token_ids`` (ids as little-endian unsigned 32-bit integers), decoding adds ``decoded`` (bytes). Null
texts are empty and have no tokens. Repeated rows each get their row; all other columns are kept, but for input columns
named like those that are added, which are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, give_back

#: New pieces, and characters of texts, after which a replay begins; they bound what a task holds.
MAX_NEW, MAX_CHARS = 100_000, 2_000_000
#: Pieces whose ids a worker remembers; beyond it the memory starts anew.
MAX_MEMORY = 200_000
#: Rank of a pair that no merge makes, and the token beyond either end of a piece.
NONE = (1 << 31) - 1


def load_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


class Pieces(dict):
    """Numbers for pieces, in the order in which they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class MergeReplay:
    """Encodes pieces of text; remembers what it has seen."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.byte_table = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        made = sorted((a << 32 | b, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None)
        self.pair_keys = np.array([k for k, _ in made] + [(1 << 63) - 1], dtype=np.int64)
        self.pair_ranks = np.array([i for _, i in made] + [NONE], dtype=np.int32)
        #: tokens of which some pair has a lower rank than the token itself
        self.uneven = {x for k, i in made for x in (k >> 32, k & NONE) if x > i}
        self.numbers, self.coded = Pieces(), []

    def look_up(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        """Ranks of the merges of token pairs, NONE where there is none."""
        keys = np.asarray(a, dtype=np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(NONE))

    def replay(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces (of one byte or more) in a row, and how many each has."""
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        end = int(lengths.sum())
        # numbers of 32 bits: a row is no longer than a text may be, and it is what a task holds most of
        of = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        last = np.cumsum(lengths) - 1
        # place ``end`` stands for what lies beyond a piece
        ids = np.append(self.byte_table[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.int32(NONE))
        after, before = np.arange(1, end + 2, dtype=np.int32), np.arange(-1, end, dtype=np.int32)
        after[last], before[last - lengths + 1], after[end] = end, end, end
        rank = self.look_up(ids, ids[after])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            own = rank[places]
            places, own = places[own < NONE], own[own < NONE]
            if len(own) > 1:
                order = np.argsort(own, kind="stable")
                places, own = places[order], own[order]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else [0]
            for x, y, r in zip(cuts, cuts[1:], own[cuts[:-1]].tolist(), strict=False):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(places[x:y])

        enter(np.arange(end, dtype=np.int32))
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            places = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
            places = places[rank[places] == r]  # else a neighbour has changed since
            if not len(places):
                continue
            p = places
            touch = after[p[:-1]] == p[1:]
            if touch.any():  # of places that overlap every other one is merged, from the left
                at = np.arange(len(p))
                begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~touch)), at, 0))
                p = p[(at - begin) % 2 == 0]
            waits = r in self.uneven
            if waits:
                q = after[p]
                left = ids[before[p]]
                left[1:][before[p[1:]] == q[:-1]] = r
                lower = np.minimum(self.look_up(r, ids[after[q]]), self.look_up(left, r)) < r
                earlier = np.cumsum(lower) - lower
                p = p[earlier == earlier[np.searchsorted(of[p], of[p])]]
            q = after[p]
            ids[p] = r
            ids[q] = -1
            rank[q] = NONE
            then = after[q]
            after[p] = then
            before[then] = p
            first = before[p]
            rank[p] = self.look_up(r, ids[then])
            rank[first] = self.look_up(ids[first], r)
            rank[end] = NONE
            enter(np.unique(np.concatenate((first, p))))
            if waits and len(places := places[rank[places] == r]):
                index[r] = [*index.get(r, []), places]
                heapq.heappush(queue, r)
        kept = ids[:end] >= 0
        return ids[:end][kept], np.bincount(of[kept], minlength=len(raw))

    def learn(self) -> None:
        """Put the ids of new pieces into the memory."""
        if len(self.numbers) == len(self.coded):
            return
        new = list(self.numbers)[len(self.coded) :]
        ids, n = self.replay([piece.encode("utf-8", "surrogatepass") for piece in new])
        coded, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        self.coded.extend(coded[x:y] for x, y in zip([0, *ends], ends, strict=False))

    def split(self, text: str) -> np.ndarray:
        """Numbers of the pieces of a text."""
        pieces = self.find(text)
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int32, len(pieces))

    def forget(self) -> None:
        if len(self.numbers) > MAX_MEMORY:
            self.numbers, self.coded = Pieces(), []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn()
        return [b"".join(map(self.coded.__getitem__, s.tolist())) for s in split]


_REPLAY: dict[tuple[str, str], MergeReplay] = {}


def _tokens(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_ranks(path))


def _decoder(tokens: list[bytes]) -> Callable[[bytes | None], bytes]:
    """What gives the bytes that coded ids stand for."""
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    starts, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def text(coded: bytes | None) -> bytes:
        ids = np.frombuffer(coded or b"", "<u4")
        n = lengths[ids]
        return data[np.arange(int(n.sum())) + np.repeat(starts[ids] - (np.cumsum(n) - n), n)].tobytes()

    return text


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``token_ids``. The vocabulary file is read once by the driver; its size is fixed.

    With ``decoded`` the ids are decoded too, as by ``decode``, in the same Python task instead of a second one beside it."""
    added = ["token_ids", "decoded"] if decoded else ["token_ids"]
    docs = docs.drop(*added)
    bound_batches(docs.sparkSession)
    shared, at, names = _tokens(docs.sparkSession, path), docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, pattern)
        if key not in _REPLAY:
            _REPLAY.clear()
            _REPLAY[key] = MergeReplay(shared.value, pattern)
        replay = _REPLAY[key]
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []  # rows that wait for the replay, and their pieces
        size = 0
        for batch in chain(batches, [None]):
            split, begin = [], 0
            for i in range(batch.num_rows if batch else 0):
                text = batch.column(at)[i].as_py() or ""
                split.append(replay.split(text))
                size += len(text)
                if size >= MAX_CHARS or len(replay.numbers) - len(replay.coded) >= MAX_NEW:
                    held.append((batch.slice(begin, i + 1 - begin), split))
                    yield from coded(replay, held)
                    held, split, begin, size = [], [], i + 1, 0
            if split:
                held.append((batch.slice(begin), split))
        yield from coded(replay, held)

    def coded(replay: MergeReplay, held: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        replay.learn()
        back = _decoder(shared.value) if decoded else None
        for rows, split in held:
            ids = [b"".join(map(replay.coded.__getitem__, s.tolist())) for s in split]
            new = [ids, list(map(back, ids))] if back else [ids]
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.binary()) for x in new)], names=[*names, *added])
        replay.forget()

    return docs.mapInArrow(lambda batches: give_back(run(batches)), docs.withColumns({c: F.lit(b"") for c in added}).schema)


def decode(rows: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes that the ids stand for."""
    rows = rows.drop("decoded")
    shared, at, names = _tokens(rows.sparkSession, path), rows.columns.index(ids_col), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _decoder(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [text(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*names, "decoded"])

    return rows.mapInArrow(lambda batches: give_back(run(batches)), rows.withColumn("decoded", F.lit(b"")).schema)


def op8_byte_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    rows = decode(coded, path)
    return rows.select("doc_id", F.expr("cast(length(token_ids) / 4 as bigint)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
