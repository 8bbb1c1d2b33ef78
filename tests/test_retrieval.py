"""Scores of documents that more questions ask about than one row takes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from poolwright.operators import retrieval, term_index
from poolwright.plans import queries
from poolwright.plans.oracles import ORACLES
from run_queries import compare

WORDS = ["river", "stone", "cloud", "lamp", "garden", "winter"]


@pytest.fixture
def asked(spark):
    rng = random.Random(6)
    docs = [(d, "\n\n".join(" ".join(rng.choices(WORDS, k=4)) for _ in range(rng.randint(0, 5)))) for d in range(12)]
    questions = [(q, " ".join(rng.sample(WORDS, 2))) for q in range(60)]
    requests = [(q, 3) for q in range(60)] + [(q, q % 12) for q in range(60)] + [(5, 99), (77, 1), (None, 2), (4, None), (1, 3), (1, 3)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(questions, "question_id long, text string"),
        spark.createDataFrame(requests, "question_id long, doc_id long"),
        docs, questions, requests,
    )


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_chunks_of_questions_give_the_same_rows(asked, at_once):
    docs, questions, requests, texts, asks, pairs = asked
    got = retrieval.request_features(docs, questions, requests, at_once=at_once)
    got = sorted((r.question_id, r.doc_id, [(p.neg, p.idx) for p in r.paras]) for r in got.collect())
    text, terms = dict(texts), {q: t.split() for q, t in asks}

    def ranked(q, d):
        paras = [p for p in text[d].split("\n\n") if p]
        return sorted((-sum(t in p for t in terms[q]), i) for i, p in enumerate(paras))

    assert got == sorted((q, d, ranked(q, d)) for q, d in pairs if q in terms and d in text)


def test_no_row_takes_all_questions_of_a_document(asked):
    """The chunks of one document are rows of their own, dealt over tasks by document and chunk."""
    docs, questions, requests = asked[:3]
    plan = retrieval.request_features(docs, questions, requests, at_once=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "_c#" in plan and "shuffle_hash" not in plan
    assert requests.filter("doc_id = 3").agg(F.count("*")).first()[0] > 7


def test_index_finds_what_a_search_finds(spark, tmp_path):
    """Terms inside words, terms of which no word holds some letters, repeated requests, null and empty texts."""
    rng = random.Random(8)
    letters = ["".join(rng.choices("abc1", k=rng.randint(1, 7))) for _ in range(60)]
    text = {d: "\n\n".join(rng.choice([" ", "-", "É"]).join(rng.choices(letters, k=5)).title() for _ in range(rng.randint(0, 4))) for d in range(15)}
    terms = {q: " ".join({w[: rng.randint(2, 5)] for w in rng.sample(letters, 4)} | {"zzz", "abcd"}) for q in range(20)}
    pairs = [(q, d) for q in range(20) for d in range(15)] + [(0, 1), (0, 1), (99, 1), (1, 99), (None, 1), (1, None), (1, 15)]
    docs = spark.createDataFrame([*text.items(), (15, None), (16, "")], "doc_id long, text string").repartition(3)
    questions = spark.createDataFrame([*terms.items(), (20, None)], "question_id long, text string")
    requests = spark.createDataFrame(pairs, "question_id long, doc_id long")

    def rows(df):
        return sorted((r.question_id, r.doc_id, r.idx, r.score) for r in df.collect())

    path = str(tmp_path / "index")
    term_index.write_index(docs, path)
    found = rows(term_index.indexed_scores(term_index.read_index(spark, path), questions, requests))
    expected = []
    for q, d in pairs:
        paras = [p for p in text.get(d, "").split("\n\n") if p]
        for k, p in enumerate(paras):
            score = sum(t in p.lower() for t in set(terms.get(q, "").split()) if len(t) >= 3)
            expected += [(q, d, k, score)] * (score > 0)
    assert found == sorted(expected) and found == rows(retrieval.paragraph_scores(docs, questions, requests))


def test_index_is_asked_without_texts(spark, tmp_path):
    """No paragraph is searched: the plan reads postings and grams, and an empty index finds nothing."""
    path = str(tmp_path / "none")
    term_index.write_index(spark.createDataFrame([], "doc_id long, text string"), path)
    questions = spark.createDataFrame([(1, "some river")], "question_id long, text string")
    out = term_index.indexed_scores(term_index.read_index(spark, path), questions, spark.createDataFrame([(1, 1)], "question_id long, doc_id long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 0
    assert not any(x in plan for x in ("_para", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_only_wanted_hits_go_to_the_requests(spark, tmp_path, monkeypatch):
    """Every document holds all terms, and is asked one of many questions: no hit of another question's term is shuffled."""
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(d, " ".join(f"term{q}x" for q in range(20)) + "\n\nterm3x") for d in range(40)], "doc_id long, text string")
    questions = spark.createDataFrame([(q, f"term{q}x") for q in range(20)], "question_id long, text string")
    requests = spark.createDataFrame([(d % 20, d) for d in range(30)], "question_id long, doc_id long")
    term_index.write_index(docs, path)
    met, join = [], type(docs).join

    def spy(left, right, on=None, how=None):
        if on == ["doc_id", "term"]:
            met.append(left.count())
        return join(left, right, on, how)

    def rows():
        return sorted(tuple(r) for r in term_index.indexed_scores(term_index.read_index(spark, path), questions, requests).collect())

    monkeypatch.setattr(type(docs), "join", spy)
    expected = sorted([(d % 20, d, 0, 1) for d in range(30)] + [(3, d, 1, 1) for d in (3, 23)])
    assert rows() == expected and met == [32]
    # Kinds may take in documents asked something else, and may be left out: the rows are the same.
    monkeypatch.setattr(term_index, "KINDS", 2)
    assert rows() == expected and 32 < met[1] < 620
    monkeypatch.setattr(term_index, "KNOWN_AT_ONCE", 0)
    assert rows() == expected and met[2] == 620 + 10


def test_a_document_without_paragraphs_has_no_row(spark, tmp_path):
    """Null, empty and blank texts: the query gives the rows of its SQL, and none for them."""
    texts = ["a lamp\nby the river", None, "", " \n\t \n", "x" * 601, "the river\n\nstone"]
    docs = [(d, t, "en", "src0", len(t or "")) for d, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "which river"), (1, "a lamp")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.used, r.chosen) for r in queries.QUERIES["select_paragraphs__o36e"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == {d: (used, chosen) for _, d, used, chosen in con.execute(ORACLES["select_paragraphs__o36e"]).fetchall()}
    assert got == {0: (20, "0,1"), 4: (0, ""), 5: (16, "0,1")}


def test_a_dotted_capital_i_is_an_i(spark, tmp_path):
    """In questions and in texts, as in SQL: by scores, by the index and by the chosen paragraphs."""
    texts = ["x" * 590 + "\nİSTANBUL lamp", "a " * 300 + "\nDAİRY", "istanbul\nriver", "İ\nISTANBUL"]
    docs = [(d, t, "en", "src0", len(t)) for d, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "İstanbul"), (1, "dairy")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("select_paragraphs__o36e", "paragraph_scores__o36c", "indexed_scores__o36c"):
        assert compare(queries.QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None, name
    chosen = {r.doc_id: r.chosen for r in queries.QUERIES["select_paragraphs__o36e"](spark, str(tmp_path)).collect()}
    assert chosen == {0: "1", 1: "1", 2: "0,1", 3: "0,1"}
