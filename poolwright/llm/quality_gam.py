"""A quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is binned and has a lookup table. Training goes round the
features: each time a shallow tree over the bins of one feature is fitted to the
gradient and added to its table. Pairs of features that explain what is left get a
table over a coarser grid, boosted in the same way. A score is a sum of table
entries, so a whole batch is scored by additions.

Features come from the text alone. The model is fitted on a bounded sample of
labelled rows (``train_rows``); every document is scored, over its whole text.

Defined cases: a null text is scored as an empty one; an empty text has a score like
any other; null labels are left out, of several labels of one doc_id the largest
counts; a null doc_id is not held out; without labels of both kinds the score is the
smoothed share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm.common import held_out, packed, plain_reads, sampled, small_batches, table, unpacked
from poolwright.llm.shingles import texts_and_words

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "marks", "stops", "wide",
    "distinct_words", "same_as_before", "top_word", "repeated_lines", "line_length", "space", "controls",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[[ord(c) for c in chars]] = 1
    return out


_RANGE = np.arange(256)
_CLASSES = np.stack(
    [
        _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _class("abcdefghijklmnopqrstuvwxyz"),
        _class("0123456789"),
        _class("#*$%&|<>@^~_=+{}[]\\/"),
        _class("!?"),
        _class(".,;:'\"()-"),
        (_RANGE >= 0xC0).astype(float),
        _class(" \t\n\r\x0b\x0c"),
        ((_RANGE < 32) & ~np.isin(_RANGE, (9, 10, 11, 12, 13)) | (_RANGE == 127)).astype(float),
        ((_RANGE & 0xC0) == 0x80).astype(float),
    ]
)


def describe(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The features of one text."""
    counts = _CLASSES @ np.bincount(data, minlength=256)
    upper, lower, digits, symbols, marks, stops, wide, space, controls, inner = counts
    chars = max(1.0, len(data) - inner)
    letters = max(1.0, upper + lower + wide)
    n = len(words)
    solid = chars - space
    ends = np.flatnonzero(data == 10)
    lines = [data[a:b].tobytes() for a, b in zip(np.r_[0, ends + 1], np.r_[ends, len(data)], strict=True) if b > a]
    distinct, often = (np.unique(words, return_counts=True)) if n else (words, np.zeros(1))
    return np.array(
        [
            np.log1p(n), solid / max(1, n), upper / letters, digits / chars, symbols / chars, marks / chars, stops / chars,
            wide / chars, len(distinct) / max(1, n), (words[1:] == words[:-1]).sum() / max(1, n - 1), often.max() / max(1, n),
            1 - len(set(lines)) / max(1, len(lines)), np.log1p(chars / max(1, len(lines))), space / chars, controls / chars,
        ]
    )


def features(texts: pa.Array) -> np.ndarray:
    rows = [describe(d, w) for d, w in texts_and_words(texts, fold=False)]
    return np.array(rows).reshape(-1, len(FEATURES))


@dataclass
class Additive:
    """Bin edges and tables; ``pairs`` are (feature, feature), their tables lie over coarse bins."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, j], "right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            out += values[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g, h, penalty):
    return g * g / (h + penalty)


def _best_cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """The cut of consecutive bins with the largest gain."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h, penalty) + _gain(g.sum() - left_g, h.sum() - left_h, penalty) - _gain(g.sum(), h.sum(), penalty)
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """A shallow tree over consecutive bins: its value in each bin."""
    gain, at = _best_cut(g, h, penalty) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + penalty))
    return np.r_[_tree(g[:at], h[:at], depth - 1, penalty), _tree(g[at:], h[at:], depth - 1, penalty)]


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """One cut of the first feature, then one of the second on either side (or the other way round)."""
    best = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, at = _best_cut(a.sum(1), b.sum(1), penalty)
        if not at:
            continue
        halves = [(a[:at].sum(0), b[:at].sum(0)), (a[at:].sum(0), b[at:].sum(0))]
        rows = [_tree(x, y, 1, penalty) for x, y in halves]
        values = np.vstack([np.tile(rows[0], (at, 1)), np.tile(rows[1], (len(a) - at, 1))])
        gain = float((2 * values * a - values**2 * (b + penalty / b.size)).sum())
        if gain > best[0]:
            best = (gain, values.T if flip else values)
    return best


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, cycles: int = 150, pairs: int = 8,
    rate: float = 0.15, penalty: float = 5.0, depth: int = 2,
) -> Additive:
    """Cyclic boosting of the logistic loss; a fifth of the rows tells when to stop."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(start=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = lambda j, n: np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1]))
    columns = range(x.shape[1])
    model.edges = [cuts(j, bins) for j in columns]
    model.coarse = [cuts(j, coarse_bins) for j in columns]
    at = [np.searchsorted(model.edges[j], x[:, j], "right") for j in columns]
    coarse = [np.searchsorted(model.coarse[j], x[:, j], "right") for j in columns]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    check = np.arange(len(y)) % 5 == 4
    learn = ~check

    def loss(raw):
        return float(np.logaddexp(0, np.where(y[check] == 1, -raw[check], raw[check])).mean())

    def boost(slots: list[tuple[np.ndarray, np.ndarray]], step, raw):
        """slots: (place of each row, flat table); returns the best state by the held-back rows."""
        best, kept, bad = loss(raw), [t.copy() for _, t in slots], 0
        for _ in range(cycles):
            for place, values in slots:
                p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                g = np.bincount(place[learn], weights=(y - p)[learn], minlength=values.size)
                h = np.bincount(place[learn], weights=(p * (1 - p))[learn], minlength=values.size)
                change = rate * step(g.reshape(values.shape), h.reshape(values.shape))
                values += change
                raw = raw + change.ravel()[place]
            now = loss(raw)
            if now < best - 1e-6:
                best, kept, bad = now, [t.copy() for _, t in slots], 0
            else:
                bad += 1
                if bad >= 8:
                    break
        for (_, values), good in zip(slots, kept, strict=True):
            values[...] = good

    boost([(at[j], model.tables[j]) for j in columns], lambda g, h: _tree(g, h, depth, penalty), model.raw(x))
    raw = model.raw(x)
    p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    ranked = []
    for a in columns:
        for b in range(a):
            shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
            place = coarse[a] * shape[1] + coarse[b]
            g = np.bincount(place[learn], weights=(y - p)[learn], minlength=shape[0] * shape[1]).reshape(shape)
            h = np.bincount(place[learn], weights=(p * (1 - p))[learn], minlength=shape[0] * shape[1]).reshape(shape)
            ranked.append((_pair_tree(g, h, penalty)[0], a, b, place, shape))
    ranked.sort(key=lambda r: (-r[0], r[1], r[2]))
    chosen = ranked[:pairs]
    model.pairs = [(a, b) for _, a, b, _, _ in chosen]
    model.pair_tables = [np.zeros(shape) for *_, shape in chosen]
    slots = [(place, values) for (*_, place, _), values in zip(chosen, model.pair_tables, strict=True)]
    boost(slots, lambda g, h: _pair_tree(g, h, penalty)[1], raw)
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Additive:
    small_batches(docs.sparkSession)
    plain_reads(docs.sparkSession)
    chosen, shift = sampled(labels, "quality", train_rows)

    @F.arrow_udf("array<double>")
    def described(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))

    rows = packed(docs, _id=F.col(doc_id).cast("long"), _text=text).join(F.broadcast(chosen), F.col("_id") == F.col("_of"))
    got = rows.select("_id", "_label", described(F.col("_text")).alias("_x")).orderBy("_id", "_x").select("_x", "_label").toArrow()
    y = got["_label"].to_numpy().astype(float)
    x = np.array(got["_x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    model = fit(x, y)
    model.start -= shift
    return model


def score(model: Additive, text: Column) -> Column:
    """The score of each text, batch by batch."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = [model.score(features(texts.slice(at, 1024))) for at in range(0, len(texts), 1024)]
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return scored(text)


def _rated(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, threshold: float, train_rows: int) -> DataFrame:
    model = train(docs, labels, doc_id, text, train_rows)
    scored = packed(docs, _text=text).withColumn("_score", score(model, F.col("_text")))
    return scored.withColumn("_predicted", (F.col("_score") >= threshold).cast("int"))


def rate(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """The documents with _score and _predicted."""
    return unpacked(_rated(docs, labels, doc_id, text, threshold, train_rows), docs.columns, "_score", "_predicted")


def accepted(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """The documents of sufficient quality, with their own columns."""
    return unpacked(_rated(docs, labels, doc_id, text, threshold, train_rows).filter("_predicted = 1"), docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted")
    )
