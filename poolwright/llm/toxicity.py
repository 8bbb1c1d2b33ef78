"""Toxicity by a weighted lexicon.

Texts are folded to a small alphabet: letters of other scripts that look like Latin ones,
digits and signs that stand for letters, and letters that are mistaken for each other (i, l,
1 and |) become one. The lexicon holds whole words and beginnings of words, each with a weight.
One automaton (Aho-Corasick) finds all entries in a text; in a word the longest entry counts. An
exception phrase (a word that an entry begins, or such a word with a neighbour) that
covers a match voids it. The weights that are found are summed and normalised by the length of the
text; a logistic curve turns sum, density and number of entries into a score.

Lexicon, exceptions and curve are learned from labels. Spark counts in how many toxic and clean
texts each word, beginning and phrase occurs; entries whose log-odds stand clear of chance
become the lexicon, and phrases around them that only clean texts hold the exceptions. The curve is
fitted on matches that a text's own third of the rows had no part in.

The model is fitted on a bounded sample of labelled rows (``train_rows``, shared out by label);
it keeps at most ``entries`` entries and as many exceptions. All documents are scored, whole.

Defined cases: a null text is scored as an empty one; an empty text, or one without a match, has a
score like any other; null labels are left out, of several labels of one doc_id the largest counts;
a null doc_id is not held out; without labels of both kinds the score is the smoothed share of
label 1; an empty table gives an empty result; extra columns ride along.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm.common import held_out, packed, sampled, small_batches, table, unpacked
from poolwright.session import materialize

TRAIN_ROWS = 10_000
THRESHOLD = 0.5
ENTRIES = 4_000
THIRDS = 3
STEMS = range(3, 9)  # letters of a beginning
CLEAR = 5.0  # standard deviations by which toxic texts with an entry exceed what chance would give
LEAST_WEIGHT = 1.5  # log-odds
CANDIDATES = 20_000

# Letters of other scripts that look like Latin ones, and what stands for letters.
LOOKALIKES = (
    ("аАΑα", "a"), ("ВвΒβ", "b"), ("сСϲ", "c"), ("ԁ", "d"), ("еЕёΕε", "e"), ("ɡ", "g"), ("һНΗ", "h"), ("іІΙιї", "i"), ("јЈ", "j"),
    ("кКΚκ", "k"), ("Ӏ", "l"), ("мМΜ", "m"), ("пΝ", "n"), ("оОΟοσ", "o"), ("рРΡρ", "p"), ("ԛ", "q"), ("г", "r"), ("ѕЅ", "s"), ("тТΤτ", "t"),
    ("υ", "u"), ("νѵ", "v"), ("ԝѡω", "w"), ("хХΧχ", "x"), ("уУΥγ", "y"), ("Ζᴢ", "z"),
)
LEET = str.maketrans("013456789@$|!", "oieasgtbgasil")
#: Letters that the folded alphabet does not tell apart.
ALIKE = str.maketrans("l", "i")

_SIGNS = "013456789@$|"
_STANDS = re.compile(rf"(?<=[^\W\d_])[{_SIGNS}!]+(?=[^\W\d_])|(?<=[^\W\d_])[{_SIGNS}]+|[{_SIGNS}]+(?=[^\W\d_])")
_ANY = re.compile(f"[{_SIGNS}!]")


class _Fold(dict):
    """Code point to its folded letter, or to a space; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        for alike, plain in LOOKALIKES:
            if char in alike:
                out = plain
                break
        else:
            if unicodedata.category(char) in ("Cf", "Mn"):
                out = ""  # invisible: joins what it splits
            else:
                wide = unicodedata.normalize("NFKC", char).lower()
                out = wide if wide.isalpha() else " "
        self[code] = out = out.translate(ALIKE)
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """The folded words of a text, each between two single spaces."""
    if _ANY.search(text):
        text = _STANDS.sub(lambda m: m[0].translate(LEET), text)
    return f" {' '.join(text.lower().translate(_FOLD).split())} "


def openings(folded: str) -> set[str]:
    """What an entry may be: words between spaces, and beginnings of words after a space."""
    words = set(folded.split())
    found = {f" {w} " for w in words if len(w) > 2}
    found.update(f" {w[:k]}" for w in words for k in STEMS if len(w) > k)
    return found


def around(folded: str, entries: set[str]) -> set[str]:
    """What an exception may be: words that an entry begins, alone and with either neighbour."""
    words = ["", *folded.split(), ""]
    found = set()
    for i in range(1, len(words) - 1):
        word = f" {words[i]} "
        if any(word[:k] in entries for k in range(STEMS[0] + 1, len(word) + 1)):
            found.add(word)
            if words[i - 1]:
                found.add(f" {words[i - 1]}{word}")
            if words[i + 1]:
                found.add(f"{word}{words[i + 1]} ")
    return found - entries


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the curve (weights of the features, then the start)."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = ()
    start: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry in self.entries.keys() | self.exceptions:
            found.add_word(entry, (entry, self.entries.get(entry, 0.0), entry in self.exceptions))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matches(folded: str, automaton) -> list[tuple[str, float]]:
    """The entries that count: the longest at each word, but where an exception covers it."""
    at, covered = {}, []
    for end, (entry, weight, spared) in automaton.iter(folded):
        begin = end - len(entry) + 1
        if spared:
            covered.append((begin, end))
        if weight and len(entry) > len(at.get(begin, ("",))[0]):
            at[begin] = (entry, weight)
    if covered and at:
        # a match that starts inside an exception's words is part of it
        reach = np.zeros(len(folded) + 1, np.int32)
        np.add.at(reach, [a for a, _ in covered], 1)
        np.add.at(reach, [b for _, b in covered], -1)
        inside = np.cumsum(reach)
        at = {b: m for b, m in at.items() if not inside[b]}
    return list(at.values())


FEATURES = 5


def describe(text: str | None, automaton) -> tuple[float, ...]:
    """The weights found in a text: their sum, and normalised by its length in words in three ways; and the length."""
    folded = fold(text or "")
    n = folded.count(" ") - 1
    met = matches(folded, automaton) if automaton is not None else []
    total, kinds = sum(w for _, w in met), sum(dict(met).values())
    return np.log1p(total), total / np.sqrt(n + 10), 10 * total / (n + 10), kinds / np.log(n + 10), np.log1p(n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> tuple[tuple[float, ...], float]:
    """A logistic regression by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = penalty * np.eye(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), a.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w[:-1]), float(w[-1])


def excess(a, b, share: float):
    """Toxic texts with a phrase beyond what chance would give, in standard deviations (numbers or columns)."""
    return (a - (a + b) * share) / ((a + b) * (share * (1 - share))) ** 0.5


def chosen_entries(counts: list[tuple[str, int, int]], toxic: int, clean: int, entries: int = ENTRIES) -> dict[str, float]:
    """Entries with weights from (phrase, toxic texts, clean texts) and how many texts there are.

    The weight is the smoothed log-odds of a text being toxic, beyond those of all texts; words that are merely
    commoner in toxic texts stay below LEAST_WEIGHT. At a word the longest entry counts, so a beginning has to
    pass by the texts that its commonest longer entry leaves to it.
    """
    base, share = np.log((toxic + 0.5) / (clean + 0.5)), toxic / (toxic + clean)
    kept: dict[str, tuple[float, float]] = {}
    above: dict[str, tuple[int, int]] = {}  # the longer entry of most toxic texts, by beginning
    for phrase, a, b in sorted(counts, key=lambda c: (-len(c[0].rstrip()), -len(c[0]), c[0])):
        more = above.get(phrase, (0, 0))
        left, weight = (a - more[0], b - more[1]), np.log((a + 0.5) / (b + 0.5)) - base
        if left[0] >= 3 and excess(*left, share) >= CLEAR and np.log((left[0] + 0.5) / (left[1] + 0.5)) - base >= LEAST_WEIGHT:
            kept[phrase], more = (float(weight), float(excess(a, b, share))), (a, b)
        parent = phrase.rstrip()[:-1]
        above[parent] = max(above.get(parent, (0, 0)), more)
    best = sorted(kept, key=lambda p: (-kept[p][1], p))[:entries]
    return {p: kept[p][0] for p in best}


def chosen_exceptions(counts: list[tuple[str, int, int]], toxic: int, clean: int, entries: int = ENTRIES) -> frozenset[str]:
    """Phrases that clean texts hold more often than chance would give."""
    share = toxic / (toxic + clean)
    spared = [(-b, p) for p, a, b in counts if b >= 5 and excess(a, b, share) < 0]
    return frozenset(p for _, p in sorted(spared)[:entries])


def _counted(rows: DataFrame, pick) -> DataFrame:
    """(phrase, n00, n01, …): in how many texts of each third and label each phrase occurs that ``pick`` names."""
    schema = pa.schema([("_third", pa.int32()), ("_label", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple] = Counter()

        def made():
            columns = [*zip(*held, strict=True), list(held.values())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for third, label, value in zip(*(batch[c].to_pylist() for c in ("_third", "_label", "_text")), strict=True):
                held.update((third, label, p) for p in pick(fold(value or "")))
                if len(held) > 200_000:
                    yield made()
        if held:
            yield made()

    counts = rows.mapInArrow(run, "_third int, _label int, phrase string, n long")
    cells = [(t, k) for t in range(THIRDS) for k in (0, 1)]
    return counts.groupBy("phrase").agg(
        *[F.sum(F.when((F.col("_third") == t) & (F.col("_label") == k), F.col("n")).otherwise(0)).alias(f"n{t}{k}") for t, k in cells]
    )


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS,
    entries: int = ENTRIES, exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """A lexicon from labelled documents; ``exceptions``: further phrases that void a match."""
    chosen, shift = sampled(labels, "toxic", train_rows)
    third = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(THIRDS)).cast("int").alias("_third")
    rows = packed(docs, _text=text, _id=F.col(doc_id).cast("long")).join(F.broadcast(chosen), F.col("_id") == F.col("_of"))
    rows = materialize(rows.select(third, F.col("_label").cast("int").alias("_label"), "_text"))
    sizes = {(r["_third"], r["_label"]): r["n"] for r in rows.groupBy("_third", "_label").agg(F.count(F.lit(1)).alias("n")).collect()}

    def texts(but: int | None) -> tuple[int, int]:
        """Toxic and clean texts outside one third."""
        return tuple(sum(n for (t, label), n in sizes.items() if label == k and t != but) for k in (1, 0))

    toxic, clean = texts(None)
    share = (toxic + 1) / (toxic + clean + 2)
    start = float(np.log(share / (1 - share))) - shift
    if not (toxic and clean):
        return Lexicon(start=start)

    a, b = (sum((F.col(f"n{t}{k}") for t in range(THIRDS)), F.lit(0)) for k in (1, 0))
    over = excess(a, b, toxic / (toxic + clean))

    def tallies(found: list, but: int | None) -> list[tuple[str, int, int]]:
        return [(r["phrase"], *(sum(r[f"n{t}{k}"] for t in range(THIRDS) if t != but) for k in (1, 0))) for r in found]

    # the model is bounded: the phrases that stand out most, on either side
    likely = _counted(rows, openings).filter((a >= 3) & (over >= CLEAR / 2)).orderBy(F.desc(over), "phrase").limit(CANDIDATES).collect()
    heads = {r["phrase"] for r in likely}
    clear = _counted(rows, lambda folded: around(folded, heads)).filter((b >= 5) & (over < 0)) if heads else None
    clear = clear.orderBy(F.desc(b), "phrase").limit(CANDIDATES).collect() if heads else []

    def built(but: int | None) -> Lexicon:
        n = texts(but)
        if not all(n):
            return Lexicon()
        spared = chosen_exceptions(tallies(clear, but), *n, entries) | {fold(e) for e in exceptions}
        return Lexicon(chosen_entries(tallies(likely, but), *n, entries), spared)

    parts = [built(t) for t in range(THIRDS)]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [p.automaton() for p in parts]
        for batch in batches:
            x = [describe(v, made[t]) for t, v in zip(batch["_third"].to_pylist(), batch["_text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch["_label"]], names=["x", "y"])

    got = rows.mapInArrow(described, "x array<double>, y int").orderBy("y", "x").toArrow()
    curve, bias = fit_curve(np.array(got["x"].to_pylist(), float).reshape(-1, FEATURES), got["y"].to_numpy().astype(float))
    whole = built(None)
    return Lexicon(whole.entries, whole.exceptions, curve, bias - shift)


def score(model: Lexicon, text: Column) -> Column:
    """The score of each text."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = model.automaton()
        for texts in batches:
            x = np.array([describe(t.as_py(), automaton) for t in texts], float).reshape(-1, FEATURES)
            yield pa.array(sigmoid(x @ np.array(model.curve or [0.0] * FEATURES) + model.start), pa.float64())

    return scored(text)


def rate(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
    train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = (),
) -> DataFrame:
    """The documents with _score and _predicted."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, doc_id, text, train_rows, exceptions=exceptions)
    scored = packed(docs, _text=text).withColumn("_score", score(model, F.col("_text")))
    return unpacked(scored.withColumn("_predicted", (F.col("_score") >= threshold).cast("int")), docs.columns, "_score", "_predicted")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted")
    )
