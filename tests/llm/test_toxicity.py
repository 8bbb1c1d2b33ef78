"""The weighted lexicon: folding, matching against a plain search, learning, held-out labels, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwright.llm import toxicity
from poolwright.llm.common import held_out, sampled

MORE = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "text", ["You IDIOT!", "you ｉｄｉｏｔ", "you 1d10t.", "you іdіоt", "you id​iot", "you, |d!ot", "yоu 1dі0t"],
)
def test_folding(text):
    assert toxicity.fold(text) == toxicity.fold("you idiot") == " you idiot "


def test_folding_leaves_numbers_and_accents():
    assert toxicity.fold("call 555 10") == " caii " and toxicity.fold("é e") == " é e " and toxicity.fold(" \n") == "  "
    assert toxicity.fold("") == "  "


def plain_matches(folded, lexicon):
    found, words, at = [], folded.split(), 0
    covered = set()
    for e in lexicon.exceptions:
        begin = folded.find(e)
        while begin >= 0:
            covered.update(range(begin, begin + len(e) - 1))
            begin = folded.find(e, begin + 1)
    for w in words:
        fit = [e for e in lexicon.entries if f" {w} ".startswith(e)]
        if fit and at not in covered:
            best = max(fit, key=len)
            found.append((best, lexicon.entries[best]))
        at += len(w) + 1
    return found


def test_matches_equal_a_plain_search():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    for _ in range(60):
        entries = {e: rng.random() + 0.1 for w in rng.sample(words, 8) for e in (f" {w} ", f" {w[:3]}")}
        spared = frozenset(f" {rng.choice(words)} {rng.choice(words)} " for _ in range(10)) | {f" {rng.choice(words)} "}
        lexicon = toxicity.Lexicon(entries, spared - entries.keys())
        text = toxicity.fold(" ".join(rng.choice(words) for _ in range(50)))
        assert sorted(toxicity.matches(text, lexicon.automaton())) == sorted(plain_matches(text, lexicon))


def docs_and_labels(spark, n=900):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeioudnrst") for _ in range(rng.randrange(3, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 40))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["gromzel", "gromzelix", "vukkat"]))
        if i % 7 == 0:
            words.insert(rng.randrange(len(words)), "vukkat garden")
        rows.append((i, " ".join(words), "en", "x", 1.0, 2, "y"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, _score double, _predicted int, _id string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learning_with_exceptions(spark):
    docs, labels = docs_and_labels(spark)
    model = toxicity.train(docs, labels)
    assert any(e.startswith(" gromze") for e in model.entries) and " vukkat garden " in model.exceptions
    out = toxicity.rate(docs, labels)
    assert out.columns == [c for c in docs.columns if c not in ("_score", "_predicted")] + ["_score", "_predicted"]
    wrong = out.join(labels, "doc_id").filter(held_out("doc_id")).agg(F.avg((F.col("_predicted") != F.col("toxic")).cast("int"))).first()[0]
    assert wrong < 0.03
    auto, values = model.automaton(), np.array(model.curve)
    for row in out.limit(20).collect():
        want = 1 / (1 + np.exp(-(np.dot(toxicity.describe(row.text, auto), values) + model.start)))
        assert abs(row["_score"] - want) < 1e-9


def test_odd_rows(spark):
    docs, labels = docs_and_labels(spark, 200)
    odd = spark.createDataFrame(
        [(None, "no id"), (1, None), (2, ""), (3, "gromzel " * 100_000), (4, "\U0001f600 漢字 \x00"), (4, "\U0001f600 漢字 \x00")], "doc_id long, text string"
    )
    out = toxicity.rate(odd, labels)
    assert out.count() == 6 and out.filter("_score is null or _score < 0 or _score > 1").count() == 0
    assert toxicity.rate(odd.limit(0), labels).count() == 0
    assert {round(r["_score"], 9) for r in toxicity.rate(odd, labels.limit(0)).collect()} == {0.5}
    empty = labels.filter("toxic = 0").unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    assert toxicity.rate(odd, empty).select("_score").distinct().count() == 1


def test_rare_labels_stay_in_the_sample(spark):
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 9999 == 1).cast("int").alias("toxic"))
    usable = {r.doc_id for r in ids.filter(~held_out("doc_id") & (F.col("toxic") == 1)).collect()}
    chosen, shift = sampled(ids, "toxic", 1000)
    got = chosen.collect()
    assert {r["_of"] for r in got if r["_label"] == 1} == usable and 700 < len(got) < 1300 and shift > 2
    few, _ = sampled(ids, "toxic", 2)
    assert {r["_label"] for r in few.collect()} == {0, 1}


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.op13(spark, MORE).join(labels, "doc_id").filter("held_out").toPandas()
    assert rows[rows.toxic == 1].predicted.mean() > 0.9 and rows[rows.toxic == 0].predicted.mean() < 0.01
