"""Quality rules, and a classifier on hashed n-grams for what they let pass.

Counted rules come first. A document they let pass is judged by a logistic
regression on hashed word 1- and 2-grams and character 3- and 4-grams, each kind as
relative frequencies. It is trained on labelled quality rows; a part of them, kept
apart, calibrates its output to a probability. Scoring runs in Arrow batches: a
document's score is a sum of means of weights, against a fixed threshold.

The model is fitted on a bounded sample of labelled rows (``train_rows``); every
document is counted and scored, over its whole text.

Defined cases: a null or empty text has no words and fails; null labels are left out,
of several labels of one doc_id the largest counts; without labels of both kinds the
probability is the smoothed share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poolwright.llm.common import packed, sampled, small_batches, table, unpacked
from poolwright.llm.shingles import mix, texts_and_words

TRAIN_ROWS = 6_000
SLOTS = 1 << 16  # for each kind of n-gram
KEEP_AT = 0.3
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
KINDS = 4
BLOCK = 1 << 20

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_INNER = (np.arange(256) & 0xC0) == 0x80  # bytes inside a character


def counts(data: np.ndarray, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    of = np.bincount(data, minlength=256)
    ends = np.flatnonzero(data == 10)
    seen, again = set(), 0
    for a, b in zip(np.r_[0, ends + 1].tolist(), np.r_[ends, len(data)].tolist(), strict=True):
        line = data[a:b].tobytes()
        if line.strip(b" \t\n\r\x0b\x0c"):
            again += line in seen
            seen.add(line)
    return len(words), int(of.sum() - of[_INNER].sum() - of[_SPACE].sum()), int(of[_SYMBOL].sum()), again, repeated_words(words)


def repeated_words(words: np.ndarray, width: int = 3) -> int:
    """Words covered by windows of ``width`` words that occur at least twice in the text."""
    n = len(words)
    if n <= width:
        return 0
    windows = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        windows = mix(windows * _U(31) + words[j : n - width + 1 + j])
    _, place, often = np.unique(windows, return_inverse=True, return_counts=True)
    hit = often[place] > 1
    covered = np.zeros(n, bool)
    for j in range(width):
        covered[j : n - width + 1 + j] |= hit
    return int(covered.sum())


def grams(data: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, slots of all its n-grams), in blocks."""
    for at in range(0, len(words), BLOCK):
        part = words[at : at + BLOCK + 1]
        yield 0, (part[:BLOCK] % _U(SLOTS)).astype(np.int64)
        if len(part) > 1:
            yield 1, (mix(part[:-1] * _U(31) + part[1:]) % _U(SLOTS)).astype(np.int64)
    for kind, n in ((2, 3), (3, 4)):
        for at in range(0, len(data) - n + 1, BLOCK):
            part = data[at : at + BLOCK + n - 1].astype(np.uint32)
            key = part[: len(part) - n + 1].copy()
            for j in range(1, n):
                key = (key << np.uint32(8)) | part[j : len(part) - n + 1 + j]
            yield kind, ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass
class Calibrated:
    """weights: one row per kind; slope and shift turn the score into a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw + self.bias) + self.shift, -30, 30)))

    def raw(self, data: np.ndarray, words: np.ndarray) -> float:
        total, number = np.zeros(KINDS), np.zeros(KINDS)
        for kind, slots in grams(data, words):
            total[kind] += self.weights[kind][slots].sum()
            number[kind] += len(slots)
        return float((total / np.maximum(number, 1)).sum())


def sparse(data: np.ndarray, words: np.ndarray) -> bytes:
    """The slots of a text and how often each occurs, kind after kind: four lengths, slots, counts."""
    count = np.zeros((KINDS, SLOTS), np.int64)
    for kind, found in grams(data, words):
        count[kind] += np.bincount(found, minlength=SLOTS)
    slots = [np.flatnonzero(row) for row in count]
    lengths = np.array([len(x) for x in slots], "<u4")
    often = [row[at] for row, at in zip(count, slots, strict=True)]
    return lengths.tobytes() + np.concatenate(slots).astype("<u2").tobytes() + np.concatenate(often).astype("<u4").tobytes()


class Rows:
    """Sparse rows, one after the other: place of each value in the weights, relative frequency, first value of each row."""

    def __init__(self, packed: list[bytes]):
        self.heads = np.cumsum([0, *((len(r) - 16) // 6 for r in packed)])
        self.slots = np.empty(self.heads[-1], np.int32)
        self.values = np.empty(self.heads[-1], np.float32)
        for r, a, b in zip(packed, self.heads, self.heads[1:]):  # noqa: B905
            lengths = np.frombuffer(r, "<u4", KINDS).astype(int)
            ends = np.cumsum([0, *lengths])
            self.slots[a:b] = np.frombuffer(r, "<u2", b - a, 16)
            self.values[a:b] = np.frombuffer(r[16 + 2 * int(b - a) :], "<u4", b - a)
            for kind in range(KINDS):
                part = slice(a + ends[kind], a + ends[kind + 1])
                self.slots[part] += kind * SLOTS
                self.values[part] /= max(1.0, self.values[part].sum())

    def blocks(self, rows: int = 256):
        n = len(self.heads) - 1
        for i in range(0, n, rows):
            j = min(i + rows, n)
            a, b = self.heads[i], self.heads[j]
            yield i, j, self.slots[a:b], self.values[a:b], np.repeat(np.arange(j - i), np.diff(self.heads[i : j + 1]))

    def raw(self, w: np.ndarray) -> np.ndarray:
        out = [np.bincount(of, weights=value * w[slot], minlength=j - i) for i, j, slot, value, of in self.blocks()]
        return np.concatenate(out) if out else np.empty(0)

    def gradient(self, error: np.ndarray, size: int) -> np.ndarray:
        g = np.zeros(size)
        for i, j, slot, value, of in self.blocks():
            g += np.bincount(slot, weights=value * error[i:j][of], minlength=size)
        return g


def fit(rows: Rows, y: np.ndarray, steps: int = 120, decay: float = 1e-7, rate: float = 3.0) -> Calibrated:
    """Adaptive gradient steps on four fifths of the rows; the others calibrate."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Calibrated(np.zeros((KINDS, SLOTS), np.float32), start)
    apart = np.arange(len(y)) % 5 == 4
    w, bias, seen, seen_bias = np.zeros(KINDS * SLOTS), start, np.full(KINDS * SLOTS, 1e-8), 1e-8
    learn = ~apart
    for _ in range(steps):
        raw = rows.raw(w) + bias
        error = np.where(learn, 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y, 0) / learn.sum()
        g = rows.gradient(error, len(w)) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.1 * error.sum() / np.sqrt(seen_bias)
    raw = (rows.raw(w) + bias)[apart]
    slope, shift = _calibrate(raw, y[apart])
    return Calibrated(w.reshape(KINDS, SLOTS).astype(np.float32), float(bias), slope, shift)


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through softened labels, by Newton steps."""
    up, down = y.sum(), len(y) - y.sum()
    if not up or not down:
        return 1.0, 0.0
    soft = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    at = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones_like(raw)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(slope, x.T @ (p - soft))
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Calibrated:
    small_batches(docs.sparkSession)
    chosen, shift = sampled(labels, "quality", train_rows)

    @F.arrow_udf("binary")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([sparse(d, w) for d, w in texts_and_words(texts, fold=False)], pa.binary())

    rows = packed(docs, _id=F.col(doc_id).cast("long"), _text=text).join(F.broadcast(chosen), F.col("_id") == F.col("_of"))
    rows = rows.select("_id", "_label", hashed(F.col("_text")).alias("_x"))
    got = rows.select("_id", F.xxhash64("_x").alias("_tie"), "_x", "_label").toArrow()
    order = np.lexsort((got["_tie"].to_numpy(), got["_id"].to_numpy()))
    label = got["_label"].to_numpy().astype(float)[order]
    packed_rows = got["_x"].take(pa.array(order)).to_pylist()
    del got
    model = fit(Rows(packed_rows), label)
    model.bias -= shift / model.slope
    return model


COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, probability double"


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT, **options) -> DataFrame:
    """The documents with _judged: the counts, base_failed, probability and kept."""
    model = train(docs, labels, doc_id, text, **options)
    weights = docs.sparkSession.sparkContext.broadcast(model)  # KINDS * SLOTS floats: 1 MiB

    @F.arrow_udf(f"struct<{COLUMNS.replace(' ', ':').replace(',:', ',')}>")
    def judged(texts: pa.Array) -> pa.Array:
        numbers, raw = [], []
        for data, words in texts_and_words(texts, fold=False):
            numbers.append(counts(data, words))
            raw.append(weights.value.raw(data, words))
        of = np.array(numbers, np.int64).reshape(-1, 5)
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        values = [pa.array(of[:, j]) for j in range(5)] + [pa.array(weights.value.probability(np.array(raw, float)))]
        return pa.StructArray.from_arrays(values, names)

    found = packed(docs, _text=text).withColumn("_found", judged(F.col("_text")))
    failed = (F.col("_found.n_words") < LEAST_WORDS) | (100 * F.col("_found.n_repeat_words") > MOST_REPEATED * F.col("_found.n_words"))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    values = F.struct(
        *[F.col(f"_found.{n}") for n in names], failed.alias("base_failed"),
        (~failed & (F.col("_found.probability") >= keep_at)).alias("kept"),
    )
    return unpacked(found, docs.columns, values.alias("_judged"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(docs, table(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    return found.select("doc_id", *[f"_judged.{n}" for n in names])
