"""Spelling variants against a plain search, and the lookup by pivots against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from poolwright.llm import spelling

UPPER = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows, noise=31, ratio=10):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def edited(rng, word, letters):
    at = rng.randrange(len(word) + 1)
    kind = rng.choice("idr")
    return word[:at] + (rng.choice(letters) if kind != "d" else "") + word[at + (kind != "i") :]


def test_documents(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 12))) for _ in range(12)]
    rows = []
    for i in range(300):
        chosen = [rng.choice(words) if rng.random() < 0.8 else edited(rng, rng.choice(words), "abzÿ×") for _ in range(40)]
        rows.append((i % 250, " ".join(w.title() if rng.random() < 0.1 else w for w in chosen)))
    rows += [(None, "Letters letters LETTERS letterß"), (1, None), (2, ""), (3, "x" * 50_000 + " " + "x" * 50_000), (3, "ab" * 30_000), (4, "ab" * 30_000)]
    docs = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], "doc_id long, text string, word string, n long, _key string, _doc string")
    out = spelling.spellings(docs.repartition(4), noise=31)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    want = plain(rows)
    assert len(got) == len(want) and set(got) == want and any(w[1] for w in want)
    assert spelling.spellings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("letters,least,most", [("ab", 7, 15), ("abcdefgh", 7, 15), ("a", 7, 15), ("abc", 62, 67)])
def test_no_pair_is_missed(spark, letters, least, most):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) for _ in range(40)}
    for _ in range(3):
        words |= {w for w in (edited(rng, w, letters + "z") for w in sorted(words)) if len(w) >= 7}
    words = sorted(words)[:700]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = Counter((r.a, r.b) for r in spelling.near_pairs(frame).collect())
    assert set(got.values()) <= {1} and set(got) == {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p)}


def test_pivots_are_the_cheapest_disjoint_pairs(spark):
    words = ["abcdefgh", "aaaaaaaab", "éabéabéabx", "zzyyxxwwvv"]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    for row in spelling.grams(frame).collect():
        three = [tuple(p) for p in row.prefix[:3]]
        cost = min(a[0] + b[0] for a, b in itertools.combinations(three, 2) if abs(a[2] - b[2]) >= 2)
        a, b = row.pivots
        assert abs(a.at - b.at) >= 2 and a.c + b.c == cost


def test_roots_follow_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w3")], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(links).collect()} == {(f"w{i}", "w9") for i in range(9)} | {("x", "w9")}
    assert spelling.roots(links.limit(0)).count() == 0
