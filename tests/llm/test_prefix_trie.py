"""The trie of conversation prefixes against a plain one, with few and many shards, and its queue when it spills."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from poolwright.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, _shard int, pconv long, conv string"


def plain(rows, graft=True):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in talks.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        built[c] = said.get(c - c % 100, [])[:h] + said[c][h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(built):
        path = tuple(built[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        for d in range(len(path)):
            kids[path[:d]].add(path[: d + 1])
        ends[path].append(str(c))
    out, leaves, saved = set(), {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        digest = hashlib.sha256(",".join(ends[path]).encode()).hexdigest()
        above = members[path[:-1]][0] if path else None
        out.add((members[path][0], len(path), above, len(members[path]), len(kids[path]), leaves[path], saved[path], digest))
    return out


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(1000), 60):
        for turn in range(rng.choice([1, 1, 2, 5, 9])):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é漢"])))
    seen, unique = set(), []
    for row in rows:  # rows of one turn are the same row, or told apart by the turn alone
        if (row[0], row[1]) not in seen:
            seen.add((row[0], row[1]))
            unique.append(row)
    return unique


@pytest.mark.parametrize("seed,each,waiting", [(1, 20, 1), (4, 100_000, 200_000)])
def test_trie(spark, seed, each, waiting):
    rows = talks(seed)
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in trie.trie(trie.grafted(trie.turns(frame)), each, waiting).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    whole = trie.conversation_trie(frame, each, waiting)
    assert {tuple(r) for r in whole.collect()} == plain(rows, graft=False)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "left out"), (7, 1, "user", "x"), (7, 1, "user", "x"), (7, None, None, None), (100, 0, "u", "t" * 300_000), (8, 2, "", "")]
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA)
    assert {tuple(r) for r in trie.trie(trie.grafted(trie.turns(frame)), 2, 1).collect()} == plain(rows)
    assert trie.trie(trie.grafted(trie.turns(frame.limit(0)))).count() == 0
    ties = spark.createDataFrame([(7, 1, r, "x", 1, "x", 2, 3, "y") for r in "abcdefg"], SCHEMA)
    once = {tuple(r) for r in trie.conversation_trie(ties).collect()}
    assert {tuple(r) for r in trie.conversation_trie(ties.repartition(5)).collect()} == once and len(once) == 8


def test_one_long_conversation_spans_shards(spark):
    rows = [(5, t, "user", str(t)) for t in range(400)] + [(6, t, "user", str(t)) for t in range(300)]
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA)
    got = {tuple(r) for r in trie.conversation_trie(frame, 50, 4).collect()}
    assert got == plain(rows, graft=False)


def test_queue_spills_and_gives_all_back():
    rng = random.Random(5)
    entries = [((-rng.randrange(50), rng.randrange(9)), rng.randrange(5), rng.randrange(5)) for _ in range(2000)]
    queue, want = trie.Waiting(17), defaultdict(lambda: [0, 0])
    for key, a, b in entries:
        queue.push(key, a, b)
        want[key][0] += a
        want[key][1] += b
    assert len(queue.runs) > 100 and {k: list(queue.take(k)) for k in sorted(want)} == dict(want)


def test_digests_of_many_members(spark, monkeypatch):
    ids = list(range(1000, 31_000))
    frame = spark.createDataFrame([(c, 0, "u", "same", 1, "x", 2, 3, "y") for c in ids], SCHEMA).repartition(7)
    got = {r.depth: r.ends_sha256 for r in trie.conversation_trie(frame).collect()}
    assert got == {0: hashlib.sha256(b"").hexdigest(), 1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}
