"""Word BPE, periodic runs and conversation repair against plain versions."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from veilmark.llm import conversation_repair, periodic_runs, word_bpe

DOCS = "doc_id long, text string, token_ids string, decoded int, runs int, collapsed long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977} é{i}" for i in range(60_000))
TEXTS = [
    None, "", " \n\t ", "one", LONG, "a b " * 30_000, "x " * 50_000 + "y", "don't WE'LL <|endoftext|>x<|startoftext|> İΣς é   \x1c日本1234²!?", "tie one", "tie one",
    " ".join("abcabd"[i % 6] for i in range(40)) + " z z z z z z z a b a b a b a b a b", "a a a a a a a a a a",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "old", 1, 2, 3) for i, t in enumerate(TEXTS)] + [(None, TEXTS[10], None, None, None, None), (8, TEXTS[8], "old", 1, 2, 3)]
    rows += [(100 + i, f"{TEXTS[10]} " * 3, "", 0, 0, 0) for i in range(60)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(query, docs, spark, sf_dir):
    sample = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert query(docs.where("1 = 0")).count() == 0
    return [(r["doc_id"], r["text"]) for d in (docs, sample) for r in d.select("doc_id", "text").collect()], [r for d in (docs, sample) for r in query(d).collect()]


def test_word_bpe_is_that_of_the_library(spark, docs, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    given, got = rows_of(word_bpe.op11_word_bpe, docs, spark, sf_dir)
    want = Counter()
    for i, t in given:
        ids = own.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, got)) == want


def test_word_bpe_memory_changes_nothing(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["tea for two", "two for tea", "", "ab" * 4000]
    want = [word_bpe.Vocabulary(path).encode(t) for t in texts]
    monkeypatch.setattr(word_bpe, "MAX_MEMORY", 2)
    known = word_bpe.Vocabulary(path)
    assert [known.encode(t) for t in texts * 2] == want * 2


def test_stale_merge_that_makes_the_same_token(tmp_path):
    """The pair a+bc waits in the queue; ab+c, which stands there when its turn comes, makes the same token and takes that turn."""
    from tokenizers import Tokenizer

    vocab = {c: i for i, c in enumerate(["a", "b", "c", "d", "ab", "bc", "abc", "cd", "bcd", "d</w>", "c</w>", "b</w>", "a</w>", "abc</w>", "bc</w>", "cd</w>"])}
    merges = [["b", "c"], ["a", "bc"], ["a", "b"], ["ab", "c"], ["b", "c</w>"], ["c", "d</w>"], ["a", "bc</w>"], ["ab", "c</w>"]]
    told = json.loads(Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json")).to_str())
    for order in itertools.permutations(range(len(merges)), len(merges)):
        if random.Random(str(order)).random() > 0.002:
            continue
        told["model"] |= {"vocab": vocab, "merges": [merges[i] for i in order]}
        told["added_tokens"] = []
        path = tmp_path / f"{'-'.join(map(str, order))}.json"
        path.write_text(json.dumps(told))
        library, known = Tokenizer.from_file(str(path)), word_bpe.Vocabulary(str(path))
        for n in range(1, 6):
            for letters in itertools.product("abcd", repeat=n):
                word = "".join(letters)
                assert library.encode(word).ids == memoryview(known.encode(word)).cast("i").tolist(), (order, word)


def plain_runs(w, most=1 << 40):
    """By comparing words q apart, for every q; of runs in one place the one with the smallest period."""
    found = []
    for q in range(1, min(len(w) // 4, most) + 1):
        i = 0
        while i + q < len(w):
            begin = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - begin >= max(6, 4 * q) and not any(s <= begin and s + n >= i + q for s, n, _ in found):
                found.append((begin, i + q - begin, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def changed(i, t):
    w = WORDS.findall(t or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
    return w


def test_periodic_runs(spark, docs, sf_dir):
    given, got = rows_of(periodic_runs.op12_periodic_runs, docs, spark, sf_dir)
    want, some = Counter(), 0
    for i, t in given:
        w = changed(i, t)
        runs = plain_runs(w, 3 if len(w) > 20_000 else len(w))  # the longest texts have no longer periods
        some += len(runs) > 1
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in dropped)
        want[i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)] += 1
    assert Counter(map(tuple, got)) == want and some > 50


def test_next_smaller_suffixes_and_runs_of_random_words():
    rng = random.Random(6)
    for _ in range(3000):
        w = []
        for _ in range(rng.randrange(9)):
            w += [rng.randrange(3) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 8)
        after, match = periodic_runs.next_smaller([*w, -1])
        for i in range(len(w)):
            j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            assert after[i] == j and w[i : i + match[i]] == w[j : j + match[i]] and (j + match[i] == len(w) or w[i + match[i]] != w[j + match[i]])
        words = [b"%d" % x for x in w]
        assert periodic_runs.runs_of(words) == plain_runs(words)


def test_reads_of_hard_texts():
    """Reads of words stay near a constant number a word where comparing from the start would need their square."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return list.__getitem__(self, i)

    n = 1 << 14
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < n:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    hard = [[0] * n, [0, 1] * (n // 2), ([0] * 128 + [1]) * 128, fibonacci[1], [bin(i).count("1") % 2 for i in range(n)], [((i + 1) & -(i + 1)).bit_length() for i in range(n)], [0, 1] * n + [2]]
    for w in hard:
        for x in (w, [40 - y for y in w]):
            Counted.reads = 0
            periodic_runs.next_smaller(Counted([*x, -1]))
            assert Counted.reads < 25 * len(w)


def plain_repair(roles, faults):
    """Cheapest edits by a search over places, output so far and costs."""
    best = None
    grammar = re.compile(r"(s?(ua)+)?")
    todo, seen = [(0, "", 0, 0, ())], set()
    import heapq

    while todo:
        cost, audit, t, state, out = heapq.heappop(todo)
        if best is not None and cost > best[0]:
            break
        initials = "".join(x[0] for x in out)
        if t == len(roles) and grammar.fullmatch(initials):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if (cost, audit, t) in seen:
            continue
        seen.add((cost, audit, t))
        due = "a" if initials.endswith("u") else "u"
        if cost < 2 * len(roles) + 1:
            heapq.heappush(todo, (cost + 5, audit + "I", t, 0, (*out, (due, -1))))
        if t < len(roles):
            heapq.heappush(todo, (cost + 2, audit + "D", t + 1, 0, out))
            if faults[t] != "must":
                extra = 5 if faults[t] else 0
                heapq.heappush(todo, (cost + 1 + extra, audit + "R", t + 1, 0, (*out, (due, t))))
                if roles[t] == due or roles[t] == "s" and not out:
                    heapq.heappush(todo, (cost + extra, audit + "K", t + 1, 0, (*out, (roles[t], t))))
    return best


def test_least_edits_of_all_short_conversations():
    kinds = "suaxSUAX-"
    for n in range(4):
        for codes in itertools.product(kinds, repeat=n):
            cost, audit, turns = conversation_repair.least_edits("".join(codes))
            want = plain_repair([c.lower() for c in codes], ["must" if c == "-" else "cut" if c.isupper() else "" for c in codes])
            names = {0: None, conversation_repair.USER: "u", conversation_repair.ASSISTANT: "a"}
            assert (cost, audit) == want[:2], codes
            assert [(i, names[s] or codes[i].lower()) for i, s in turns] == [(i, r) for r, i in want[2]]
    rng = random.Random(8)
    for _ in range(300):
        codes = "".join(rng.choice("suaxua-") for _ in range(rng.randrange(4, 8)))
        assert conversation_repair.least_edits(codes)[:2] == plain_repair(list(codes), ["must" if c == "-" else "" for c in codes])[:2]


def test_long_conversation_takes_work_in_proportion():
    codes = "".join(random.Random(1).choice("suaUA-x") for _ in range(100_000))
    layers = conversation_repair.cost_layers(codes)
    assert sum(len(x) for x in layers) <= 4 * (len(codes) + 1)
    cost, audit, turns = conversation_repair.least_edits(codes)
    assert cost == len(layers) - 1 and len(audit) - audit.count("I") == len(codes) and len(turns) == len(audit) - audit.count("D")


def plain_conversations(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        conversations[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = Counter()
    for conv, turns in conversations.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        roles, faults, count = [], [], Counter()
        for k, (_, role, text) in enumerate(turns):
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not solid.strip(" \t\n\v\f\r") else "duplicate" if (role, text) in [x[1:] for x in turns[:k]] else "" if solid[-1] in ".!?" else "truncated"
            count[fault] += 1
            roles.append(role[:1] if role[:1] in ("s", "u", "a") else "x")
            faults.append("must" if fault in ("blank", "duplicate") else fault)
        cost, audit, repaired = plain_repair(roles, faults)
        text = "\n".join(f"{'user:' if r == 'u' else 'assistant:'}" if i < 0 else f"{turns[i][1] if turns[i][1][:1] == r else {'u': 'user', 'a': 'assistant'}[r]}:{turns[i][2]}" for r, i in repaired)
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha(text)] += 1
    return out


def test_conversation_repair(spark, sf_dir):
    rng = random.Random(12)
    texts = ["Yes.", "No", "Why?\n", " ", "", None, "é!  ", "Then. so", "ok ", "...", "Yes. "]
    rows = []
    for conv in [*range(300), None]:
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, rng.choice((turn, turn, turn + 3, None)), rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "", "ua")), rng.choice(texts)))
    rows += rows[:20]
    turns = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, present boolean, _h int")
    query = conversation_repair.op13_conversation_repair
    got = Counter(map(tuple, query(turns).collect()))
    assert got == plain_conversations(rows)
    assert any(k[6:8] == (0, "") for k in got) and query(turns.where("1 = 0")).count() == 0
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    small = [r for r in table.select("conv_id", "turn", "role", "text").collect() if r["conv_id"] % 3 == 0]
    want = plain_conversations([tuple(r) for r in small])
    found = Counter(map(tuple, query(table).collect()))
    assert len(found) == table.select("conv_id").distinct().count() and not want - found


def test_one_long_conversation(spark):
    rows = spark.range(60_000).selectExpr("1 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text")
    r = conversation_repair.repair_conversations(rows).first()
    assert (r["cost"], r["audit"], len(r["repaired"])) == (0, "K" * 60_000, 60_000)
