"""A whole question turn and a whole read, on small tables, with every call counted."""

import os
import sys
import uuid
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from poolwright.operators import extraction, grounding, reading, turn
from poolwright.operators.ordering import first_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
SECTION = "doc_id long, idx int, title string, label string, mime string, data binary, too_big boolean, track string, page int, note string"


def calls(folder):
    return Counter(f.rsplit("-", 1)[0] for f in os.listdir(folder))


def called(folder, name):
    open(os.path.join(folder, f"{name}-{uuid.uuid4().hex}"), "w").close()


def model_in(folder, lost=(), blind=()):
    def model():
        def ask(prompt, parts):
            called(folder, prompt)
            if prompt in blind and any(p["media_type"].startswith("image/") for p in parts):
                raise ValueError("no vision engine")
            if prompt in lost and any(p["ref"] for p in parts):
                raise ValueError("gone")
            assert all(p["content"] or p["ref"] for p in parts)
            by = "key" if "key" in parts[0] and prompt.startswith("keyed") else "path"
            seen = sorted("ref" if p["ref"] else p["content"] for p in parts)
            return "|".join(seen), "m", "e", {p[by]: f"{prompt}:{p[by]}" for p in parts if p["path"] != grounding.NOTE_PATH}

        return ask

    return model


@pytest.fixture
def pool(spark):
    schema = "pool_id string, seq long, doc_id long, title string, kind string, state string, text string, mime string"
    rows = [("p", 0, 1, "a", "text", "", "alpha", "text/plain"), ("p", 1, 2, "b", "file", "ready", "beta", "application/pdf"), ("p", 2, 3, "c", "file", "failed", None, "application/pdf")]
    pictures = spark.createDataFrame([(2, 0, 1, b"picture")], "doc_id long, idx int, page int, data binary")
    return spark.createDataFrame(rows, schema), pictures


def asked(spark, *texts):
    return spark.createDataFrame([(k, "p", t) for k, t in enumerate(texts)], "question_id long, pool_id string, text string")


def outputs(answers):
    return {(r.turn, r.question_id): (r.output, r.error) for r in answers.collect()}


def test_turns_with_a_ledger(spark, pool, tmp_path):
    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    one, two = asked(spark, "plain", "blind"), asked(spark, "plain", "lost", "blind")
    answers, ledger = turn.ask_turns(*pool, [one, two], model_in(folder, {"lost"}, {"blind"}), str(tmp_path / "refs"))
    got = outputs(answers)
    assert got[1, 0][0].count("ref") == 0 and "alpha" in got[1, 0][0] and "c" in got[1, 0][0]  # the note names the unread file
    assert got[2, 0][0].split("|").count("ref") == 3  # both texts and the picture are references now
    assert got[2, 1][0].split("|").count("ref") == 0 and "beta" in got[2, 1][0]  # lost: packed again in full
    assert got[2, 2][0].split("|").count("ref") == 2 and grounding.NO_VISION_NOTE in got[2, 2][0]  # texts stay references
    assert all(error == "" for _, error in got.values())
    assert calls(folder) == {"plain": 2, "blind": 4, "lost": 2}
    kept = {(r.doc_id, r.part, r.idx): (r.ref, r.turn) for r in ledger.collect()}
    assert set(kept) == {(1, "text", -1), (2, "text", -1), (2, "image", 0)} and {t for _, t in kept.values()} == {2}
    # A turn that is run again reads what the turn before left, and leaves the same.
    again, after = turn.ask_turns(*pool, [two], model_in(folder, {"lost"}, {"blind"}), str(tmp_path / "refs"), first=2)
    assert {r.question_id: r.output for r in again.collect()} == {q: o for (t, q), (o, _) in got.items() if t == 2}
    assert {(r.doc_id, r.part, r.idx): (r.ref, r.turn) for r in after.collect()} == kept
    assert len({r.doc_id for r in turn.ledger_at(spark, str(tmp_path / "refs"), 1).collect()}) == 2


def test_failed_questions_alone_lose_references(spark, pool, tmp_path):
    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    docs, pictures = pool
    other = docs.withColumns({"pool_id": F.lit("q"), "doc_id": F.col("doc_id") + 10})
    both, questions = docs.unionByName(other), asked(spark, "lost").unionByName(spark.createDataFrame([(9, "q", "plain")], "question_id long, pool_id string, text string"))
    held = spark.createDataFrame([(d, "text", -1, f"old{d}", 0) for d in (1, 2, 11, 12, 77)], turn.LEDGER)
    answers, ledger = turn.ask_turn(both, pictures, held, questions, model_in(folder, {"lost"}), 1)
    answers.collect()
    refs = {r.doc_id: r.ref for r in ledger.filter("part = 'text'").collect()}
    assert calls(folder) == {"lost": 2, "plain": 1}
    assert refs[77] == "old77" and refs[1].startswith("lost:") and refs[11].startswith("plain:")


def test_keyed_references_tell_equal_titles_apart(spark, pool, tmp_path):
    folder = str(tmp_path)
    docs, pictures = pool
    same = docs.withColumn("title", F.lit("same"))
    for prompt, keyed, texts in (("by title", False, 1), ("keyed", True, 2)):
        _, ledger = turn.ask_turn(same, pictures, turn.empty_ledger(spark), asked(spark, prompt), model_in(folder), 1, keyed=keyed)
        assert ledger.filter("part = 'text'").count() == texts


def recogniser_in(folder, out=(), slow=(), late=(), bad=()):
    def recogniser():
        def read(name, mime, data, attempt):
            key = data.decode()
            called(folder, key)
            if key in out:
                raise ConnectionError("down")
            if key in slow or key in late and not attempt:
                raise TimeoutError
            if key in bad:
                raise ValueError("bad page")
            return f"text {key}", "e", "m"

        return read

    return recogniser


def sections(spark, *docs):
    rows = [(d, k, "t", f"page {k + 1}", "image/png", f"{d}.{k}".encode(), False, "", k + 1, "") for d, n in docs for k in range(n)]
    return spark.createDataFrame(rows, SECTION)


def plans(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, total int, has_text boolean, has_ai boolean")


def test_a_read_goes_on_where_it_stopped(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(folder)
    work, plan = sections(spark, (1, 3), (2, 2), (3, 2)), plans(spark, (1, 3, False, True), (2, 2, True, True), (3, 2, False, False))
    first = reading.read_pass(work, plan, recogniser_in(folder, out={"1.1", "2.0"}, late={"1.0"}, bad={"2.1"}), path, 1)
    state = {r.doc_id: (r.state, r.done, r.total) for r in reading.verdicts(first, plan).collect()}
    assert state == {1: ("failed", 1, 3), 2: ("ready", 0, 2), 3: ("failed", 0, 0)}
    second = reading.read_pass(work, plan, recogniser_in(folder), path, 2)
    states = reading.verdicts(second, plan)
    assert {r.doc_id: (r.state, r.done, r.total) for r in states.collect()} == {1: ("ready", 0, 0), 2: ("ready", 0, 0), 3: ("failed", 0, 0)}
    # what was read is not read again; a time-out is the second try of one section, an outage no try
    assert calls(folder) == {"1.0": 2, "1.1": 2, "1.2": 1, "2.0": 2, "2.1": 1}
    local = spark.createDataFrame([(2, "LOCAL\n")], "doc_id long, text string")
    text = {r.doc_id: (r.text, r.source) for r in reading.texts(second, plan, local, states).collect()}
    assert text == {1: ("text 1.0\n\ntext 1.1\n\ntext 1.2", "ai"), 2: ("LOCAL\n\ntext 2.0\n\n[page 2: could not be read: bad page]", "mixed")}
    third = reading.read_pass(work, plan, recogniser_in(folder), path, 3)
    assert sum(calls(folder).values()) == 8 and third.count() == 5


def test_timeouts_outlive_a_restart(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(folder)
    work, plan = sections(spark, (1, 2)), plans(spark, (1, 2, False, True))

    def flaky():
        state = {"n": 0}

        def read(name, mime, data, attempt):
            state["n"] += 1
            raise TimeoutError if attempt == 0 else ConnectionError("down")

        return read

    first = {r.idx: (r.outcome, r.timeouts) for r in reading.read_pass(work, plan, flaky, path, 1).collect()}
    assert first == {0: ("interrupted", 1), 1: ("interrupted", 1)}
    second = {r.idx: (r.outcome, r.timeouts) for r in reading.read_pass(work, plan, recogniser_in(folder, slow={"1.0"}), path, 2).collect()}
    assert second == {0: ("too_slow", 2), 1: ("read", 1)} and calls(folder) == {"1.0": 1, "1.1": 1}


def test_another_plan_starts_anew_and_a_pass_can_be_repeated(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(folder)
    reading.read_pass(sections(spark, (1, 2)), plans(spark, (1, 2, False, True)), recogniser_in(folder), path, 1)
    for _ in range(2):
        longer = reading.read_pass(sections(spark, (1, 3)), plans(spark, (1, 3, False, True)), recogniser_in(folder), path, 2)
        assert longer.filter("total = 3").count() == 3 and longer.count() == 5
    assert calls(folder) == {"1.0": 3, "1.1": 3, "1.2": 2}
    none = reading.read_pass(sections(spark).limit(0), plans(spark, (1, 0, True, True)), recogniser_in(folder), path, 3)
    assert reading.verdicts(none, plans(spark, (1, 0, True, True))).first().state == "ready"


def test_first_rows_refuses_what_spark_would_not_cut(spark):
    rows = spark.range(50_000).withColumn("k", F.col("id") % 2)  # more rows than the limit, else Spark has no need to cut
    with pytest.raises(ValueError):
        first_rows(rows, ["k"], ["id"], 1001)
    plan = first_rows(rows, ["k"], ["id"], grounding.ROUND_UNITS)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pool_is_measured_once_for_all_turns(spark, pool, tmp_path, monkeypatch):
    made, measure = [], grounding.sized_units
    monkeypatch.setattr(grounding, "sized_units", lambda *a: made.append(a) or measure(*a))
    one = asked(spark, "plain")
    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    turn.ask_turns(*pool, [one, one], model_in(folder), str(tmp_path / "refs"))
    assert len(made) == 1


def test_only_texts_that_are_walked_are_split(spark, monkeypatch):
    schema = "pool_id string, seq long, doc_id long, title string, kind string, state string, text string, mime string"
    text = "aa\n\n" + "long " * 20
    docs = spark.createDataFrame([("p", k, k, f"d{k}", "file", "ready", text, "application/pdf") for k in range(40)], schema)
    questions = spark.createDataFrame([(1, "p", "long"), (2, "p", "other")], "question_id long, pool_id string, text string")
    split, features = [], grounding.paragraph_features
    monkeypatch.setattr(grounding, "paragraph_features", lambda cut, *a: split.append(cut.count()) or features(cut, *a))
    budget = 5
    packed = grounding.pack_pool(grounding.context_units(docs), docs, questions, budget, round_units=3).collect()
    # The first three take two bytes each until one is left; behind them nothing fits for any question.
    assert split == [3]
    assert sorted(r.doc_id for r in packed if r.decision == "partial") == [0, 1]
    assert len(packed) == 40 and sum(r.sent for r in packed) == 4
