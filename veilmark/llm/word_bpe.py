"""BPE encoding and decoding with word ends, by a queue of merges over a linked list of symbols.

A vocabulary file in the format of the tokenizers library holds the tokens, the merges in the order of their ranks, the suffix of a word's last
symbol and the special tokens. Texts are cut into words at white space, words normalised and cut into pieces as the file says; a piece
starts as one symbol for each byte. A queue holds the merges that are possible, by rank and place. A
merge that comes off the queue joins a symbol with the next in the list, which is then skipped, and enters the two new neighbours; one whose
symbols have changed since is stale and passed over, unless they now make the same token. A special token in a text is one token. Decoding puts the vocabulary's
strings together with a space between two, as the library does for a vocabulary without a decoder.

Encoding adds ``token_ids`` (array of ints), decoding adds ``decoded``. Null texts are empty and have no tokens; an unknown id decodes to nothing. Repeated rows
each get their row; input columns named like those that are added are replaced. A task remembers the ids of up to MAX_MEMORY words and as many pieces, which
bounds its memory; ids do not depend on what it remembers.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Words, and pieces, whose ids a worker remembers; beyond it the memory starts anew.
MAX_MEMORY = 500_000
#: Characters of texts in a batch that a task hands back.
OUT_CHARS = 4_000_000
#: Fixed value: white space by the Unicode property White_Space.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


class Vocabulary:
    """Tokens, merges and special tokens of a file; encodes words and remembers them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        own = Tokenizer.from_file(path)
        self.normalise, self.cut = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        model = told["model"]
        self.ids = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: pair of tokens to rank, and the token that the merge of a rank makes
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special = {t: np.int32(i).tobytes() for t, i in special.items()}
        self.find_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")").split if special else lambda w: [w]
        self.plain_special = all(t.startswith("<") for t in special)
        names = {i: t for t, i in (self.ids | special).items()}
        self.strings = [names.get(i, "") for i in range(max(names) + 1)]
        self.split_space, self.odd = re.compile(SPACE).split, re.compile("[\x1c-\x1f]").search
        self.memory: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        # where the file lower-cases and takes what a pattern matches, ASCII words, which are most, are cut without the library
        steps = told["pre_tokenizer"].get("pretokenizers", [told["pre_tokenizer"]])
        lowers = [x["type"] for x in told["normalizer"].get("normalizers", [told["normalizer"]])] == ["NFC", "Replace", "Lowercase"]
        matches = [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.cut_ascii = regex.compile(steps[0]["pattern"]["Regex"]).findall if lowers and matches else None

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece, which has a letter for each of its bytes."""
        ids, ranks, made = self.ids, self.ranks, self.made
        symbols = [*map(ids.get, piece[:-1]), ids.get(piece[-1:] + self.suffix)]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        end = len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        # a merge that waits is one number: its rank, then its place
        queue = [r << 32 | i for i in range(end - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            first = heapq.heappop(queue)
            token, i = made[first >> 32], first & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j == end:
                continue
            rank = ranks.get((symbols[i], symbols[j]))
            if rank is None or made[rank] != token:
                continue  # stale
            symbols[i], symbols[j] = token, -1
            then = after[i] = after[j]
            if then < end:
                before[then] = i
                if (rank := ranks.get((token, symbols[then]))) is not None:
                    heapq.heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := ranks.get((symbols[h], token))) is not None:
                heapq.heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> bytes:
        """Ids of a word without white space, as 32-bit integers."""
        known, coded = self.known, []
        for part in self.find_special(word) if "<" in word or not self.plain_special else (word,):
            if part in self.special:
                coded.append(self.special[part])
                continue
            if self.cut_ascii and part.isascii() and part.isprintable():
                pieces = self.cut_ascii(part.lower())
            else:
                pieces = [p for p, _ in self.cut(self.normalise(part))] if part else []
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    if len(known) >= MAX_MEMORY:
                        known.clear()
                    found = self.encode_piece(p)
                    ids = known[p] = struct.pack(f"{len(found)}i", *found)
                coded.append(ids)
        return b"".join(coded)

    def split(self, text: str) -> list[str]:
        # Python's own split takes four more control characters for white space
        return self.split_space(text) if self.odd(text) else text.split()

    def encode(self, text: str) -> bytes:
        memory, coded = self.memory, []
        for word in self.split(text):
            ids = memory.get(word)
            if ids is None:
                if len(memory) >= MAX_MEMORY:
                    memory.clear()
                ids = memory[word] = self.encode_word(word)
            coded.append(ids)
        return b"".join(coded)


_KNOWN: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file that every executor has, kept by a worker for its further tasks."""
    if path not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[path] = Vocabulary(path)
    return _KNOWN[path]


def _sliced(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that have rows of OUT_CHARS together, or one larger row."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > OUT_CHARS:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, as the library gives without added special tokens."""
    docs = docs.drop("token_ids")
    bound_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            lengths = np.array([len(t or "") for t in batch.column(at).to_pylist()], dtype=np.int64)
            for part in _sliced(batch, lengths):
                coded = [known.encode(t or "") for t in part.column(at).to_pylist()]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*names, "token_ids"])

    return docs.mapInArrow(run, docs.withColumn("token_ids", F.lit(None).cast("array<int>")).schema)


def decode(rows: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``rows`` with ``decoded``, the tokens' strings with a space between two; special tokens stay."""
    rows = rows.drop("decoded")
    bound_batches(rows.sparkSession)
    at, names = rows.columns.index(ids_col), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # every string with a space before it; 0 stands for no string
        strings = [b"", *(b" " + t.encode() if t else b"" for t in vocabulary(path).strings)]
        lengths = np.array([len(t) for t in strings], dtype=np.int64)
        starts, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(strings), dtype=np.uint8)

        def text(ids: np.ndarray) -> bytes:
            ids = np.where((ids >= 0) & (ids < len(strings) - 1), ids + 1, 0)
            n = lengths[ids]
            return data[np.arange(int(n.sum())) + np.repeat(starts[ids] - (np.cumsum(n) - n), n)].tobytes()[1:]

        for batch in batches:
            listed = batch.column(at)
            for part in _sliced(batch, 4 * np.array([len(x) if x.is_valid else 0 for x in listed], dtype=np.int64)):
                column = part.column(at)
                found = [text(column[i].values.to_numpy(zero_copy_only=False).astype(np.int64)) if column[i].is_valid and len(column[i]) else b"" for i in range(len(column))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary()).cast(pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit("")).schema)


def op11_word_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = encode(docs.select("doc_id", "text"), path).drop("text")
    coded = coded.withColumns({"n_tokens": F.size("token_ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256)})
    return decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
