"""The steps of reading fed with each other's output, and calls counted."""

import os

import pytest
from pyspark.sql import functions as F

from poolwright.operators import extraction, reading, recognise
from poolwright.session import scratch_folder


def attempts(spark, rows):
    return spark.createDataFrame([(d, x, k, o) for k, (d, x, o) in enumerate(rows)], "doc_id long, idx int, t long, outcome string")


def plans(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, total int, has_text boolean, has_ai boolean")


def verdicts(spark, log, *plan):
    ends = extraction.section_outcomes(attempts(spark, log), ["t"])
    progress = {r.doc_id: (r.done, r.state) for r in extraction.read_progress(ends, plans(spark, *plan)).collect()}
    legible = ends.withColumn("legible", F.col("outcome") == "read")
    final = {r.doc_id: tuple(r)[1:] for r in extraction.final_state(plans(spark, *plan), legible).collect()}
    return {(r.doc_id, r.idx): (r.outcome, r.attempts) for r in ends.collect()}, progress, final


def test_slow_section_is_named_and_the_rest_read(spark):
    log = [(1, 0, "read"), (1, 1, "timeout"), (1, 1, "timeout"), (1, 2, "read")]
    ends, progress, final = verdicts(spark, log, (1, 3, False, True))
    assert ends[1, 1] == ("too_slow", 2) and progress[1] == (3, "complete")
    assert final[1] == ("ready", "", 0, 0, True, False)


def test_outage_interrupts_and_the_read_goes_on_there(spark):
    log = [(1, 0, "read"), (1, 1, "timeout"), (1, 1, "outage")]
    ends, progress, final = verdicts(spark, log, (1, 3, False, True))
    assert ends[1, 1] == ("interrupted", 1) and progress[1] == (1, "failed")
    state, reason, done, total, images, results = final[1]
    assert (state, done, total, images, results) == ("failed", 1, 3, True, True) and "after section 1 of 3 (no AI engine" in reason
    ends, progress, final = verdicts(spark, log + [(1, 1, "read"), (1, 2, "read")], (1, 3, False, True))
    assert ends[1, 1] == ("read", 2) and progress[1] == (3, "complete") and final[1][0] == "ready"
    ends, _, _ = verdicts(spark, log + [(1, 1, "timeout")], (1, 3, False, True))
    assert ends[1, 1] == ("too_slow", 2)  # the outage was no attempt


def test_text_stays_usable_while_pictures_wait(spark):
    log = [(1, 0, "timeout"), (1, 1, "read"), (2, 0, "read"), (2, 2, "read"), (3, 0, "outage")]
    _, progress, final = verdicts(spark, log, (1, 2, True, True), (2, 3, False, True), (3, 1, True, True), (4, 2, False, True))
    assert progress == {1: (0, "ready"), 2: (1, "reading"), 3: (0, "ready"), 4: (0, "reading")}
    assert {d: f[:1] + f[2:] for d, f in final.items()} == {
        1: ("ready", 0, 2, True, True), 2: ("reading", 1, 3, True, True), 3: ("ready", 0, 1, True, True), 4: ("reading", 0, 2, True, True)
    }


def test_what_is_kept(spark):
    log = [(3, 0, "too_big"), (4, 0, "error"), (4, 1, "error"), (5, 0, "note")]
    _, _, final = verdicts(
        spark, log, (1, 0, True, True), (2, 0, False, True), (3, 1, False, True), (4, 2, False, True), (5, 1, False, False), (6, 2, False, False)
    )
    assert {d: (f[0], f[4], f[5]) for d, f in final.items()} == {
        1: ("ready", True, False), 2: ("failed", True, True), 3: ("failed", True, True), 4: ("failed", False, False), 5: ("failed", False, False), 6: ("failed", True, True)
    }
    assert "not configured" in final[6][1] and "No legible text" in final[5][1]


def test_local_text_once_before_the_parts(spark):
    local = spark.createDataFrame([(1, " LOCAL\n\n"), (2, "only"), (4, "x")], "doc_id long, text string")
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 3, "c"), (3, 1, "d"), (3, 2, "e"), (4, 5, "one ")]
    read = spark.createDataFrame([(d, p, t, True, "m", "e") for d, p, t in rows], "doc_id long, part int, text string, any_text boolean, model string, engine string")
    got = {(r.doc_id, r.part): (r.text, r.source) for r in extraction.merge_tracks(local, read).collect()}
    assert got == {
        (1, 0): ("LOCAL\n\na", "mixed"), (1, 1): ("b", "mixed"), (1, 3): ("c", "mixed"), (2, 0): ("only", "text-layer"),
        (3, 1): ("d", "ai"), (3, 2): ("e", "ai"), (4, 5): ("x\n\none", "mixed"),
    }


def counting(folder, blind=()):
    """A model that leaves a file for each call."""
    def model():
        def ask(prompt, parts):
            import uuid

            open(os.path.join(folder, f"{prompt}-{uuid.uuid4().hex}"), "w").close()
            if prompt in blind and any(p["media_type"].startswith("image/") for p in parts):
                raise ValueError("no vision engine")
            if prompt == "stale" and any(p["ref"] for p in parts):
                raise ValueError("gone")
            return prompt.upper(), "m", "e", {}

        return ask

    return model


def test_a_question_is_asked_once(spark, tmp_path):
    parts = spark.createDataFrame(
        [(1, 0, "p", "text/plain", "c", "", "whole"), (2, 0, "q", "image/png", "c", "", "whole"), (3, 0, "r", "text/plain", "", "ref", "ref")],
        "question_id long, ord long, path string, media_type string, content string, ref string, decision string",
    )
    prompts = spark.createDataFrame([(1, "plain"), (2, "seen"), (3, "stale")], "question_id long, prompt string")
    model = counting(str(tmp_path), {"seen"})
    out = recognise.answer(parts, prompts, model)
    for _ in range(2):
        assert {r.question_id: r.output for r in out.collect()} == {1: "PLAIN", 2: "SEEN", 3: ""}
    due = spark.createDataFrame([(3, True)], "question_id long, retry_due boolean")
    full = parts.withColumns({"ref": F.lit(""), "content": F.lit("c")})
    done = recognise.retry_in_full(out, due, full, prompts, model)
    for _ in range(2):
        assert {r.question_id: r.output for r in done.collect()} == {1: "PLAIN", 2: "SEEN", 3: "STALE"}
    calls = [f.split("-")[0] for f in os.listdir(tmp_path)]
    assert sorted(calls) == ["plain", "seen", "seen", "stale", "stale"]


def test_a_section_is_read_once(spark, tmp_path):
    folder = str(tmp_path)

    def reader():
        def read(name, mime, data):
            import uuid

            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return f"text of {name}", "e", "m"

        return read

    sections = spark.createDataFrame(
        [(1, k, "t", f"page {k}", "image/png", b"x", False, "image", k, "") for k in range(3)],
        "doc_id long, idx int, title string, label string, mime string, data binary, too_big boolean, track string, page int, note string",
    )
    results = recognise.read_sections(sections, reader)
    text, summary = extraction.assemble_sections(results), extraction.section_summary(results)
    assert text.count() == 1 and summary.count() == 1 and len(os.listdir(folder)) == 3


def test_scratch_tables_go(spark):
    from poolwright.session import drop, materialize, run_folder, scratch

    with scratch(spark):
        kept = materialize(spark.range(5))
        assert kept.count() == 5
        path = kept.inputFiles()[0].split("file://")[-1]
        assert run_folder(spark) in path and scratch_folder(spark) in path
    assert not os.path.exists(path)
    other = materialize(spark.range(5))
    gone = other.inputFiles()[0].split("file://")[-1]
    drop(other)
    assert not os.path.exists(gone)
    with pytest.raises(Exception):
        other.count()


def test_content_of_what_is_sent(spark):
    """Whole texts, chosen paragraphs, pictures, and files that were never read: as text or base64."""
    import base64

    from poolwright.operators import grounding

    schema = "pool_id string, seq long, doc_id long, title string, kind string, state string, text string, mime string, data binary"
    rows = [
        ("p", 0, 1, "note", "text", "", " hello \n", "text/markdown", None),
        ("p", 1, 2, "scan", "file", "ready", "aa\n\nbbbb\n\ncc", "application/pdf", None),
        ("p", 2, 3, "legacy png", "file", "", None, "image/png", bytes(range(256))),
        ("p", 3, 4, "legacy txt", "file", "", None, "text/plain", "grüße".encode()),
        ("p", 4, 5, "pending", "file", "pending", "x", "text/plain", None),
    ]
    docs = spark.createDataFrame(rows, schema)
    pictures = spark.createDataFrame([(2, 0, 1, b"\x00\xffpicture")], "doc_id long, idx int, page int, data binary")
    asked = spark.createDataFrame([(7, "p", "bbbb")], "question_id long, pool_id string, text string")
    units = grounding.context_units(docs, pictures)

    def sent(budget):
        packed = grounding.pack_pool(units, docs, asked, budget)
        parts = grounding.context_parts(packed, asked)
        return {(r.doc_id, r.part): r.content for r in grounding.with_content(parts, docs, pictures).collect()}

    assert sent(10_000) == {
        (1, "text"): "hello", (2, "text"): "aa\n\nbbbb\n\ncc", (2, "image"): base64.b64encode(b"\x00\xffpicture").decode(),
        (3, "raw"): base64.b64encode(bytes(range(256))).decode(), (4, "raw"): "grüße",
    }
    few = sent(16)  # the second text is cut to what answers, then in order; nothing else fits
    assert few == {(1, "text"): "hello", (2, "text"): "aa\n\nbbbb"}
    gaps = grounding.gap_rows(grounding.pack_pool(units, docs, asked, 16), docs)
    assert {"legacy png", "legacy txt", "scan (image on page 1).jpg"} <= {r.path for r in gaps.collect()}


def test_no_bytes_of_files_in_an_exchange(spark):
    from poolwright.operators import ingest

    parts = spark.createDataFrame([(1, 0, "a.png", b"\x89PNG\r\n\x1a\n", 8)], "batch long, ord long, name string, data binary, size long")
    plan = ingest.judge_uploads(parts)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :].split("\n")
    assert not any("data#" in line and line.strip(" :+-").startswith(("Join", "Window", "Aggregate")) for line in below)


def test_plan_with_sizes(spark):
    pdf = "application/pdf"
    files = spark.createDataFrame(
        [(1, "text/plain", 10**9), (2, "image/png", 100), (3, "image/png", 101), (4, pdf, 100), (5, pdf, 1000), (6, pdf, 101), (7, pdf, 10**9), (8, pdf, 10**9), (9, "x/y", 1), (10, pdf, 101)],
        "doc_id long, mime string, bytes long",
    )
    layer = spark.createDataFrame([(7, True), (8, False)], "doc_id long, coherent boolean")
    images = spark.createDataFrame([(8, 0), (8, 1)], "doc_id long, idx int")
    pages = spark.createDataFrame([(5, 1, 60), (5, 2, 40), (5, 3, 500), (5, 4, 1), (4, 1, 100), (10, 1, 101), (1, 1, 5)], "doc_id long, page long, bytes long")
    got = {r.doc_id: tuple(r)[1:] for r in extraction.read_plan(files, layer, images, pages, 100).collect()}
    assert got == {
        1: ("text-layer", "none", 0, 0), 2: ("", "image", 1, 0), 3: ("", "image", 1, 1), 4: ("", "pages", 1, 0), 5: ("", "pages", 3, 1),
        6: ("", "pages", 1, 1), 7: ("text-layer", "none", 0, 0), 8: ("", "images", 2, 0), 9: ("", "unreadable", 0, 0), 10: ("", "pages", 1, 1),
    }
    plain = {r.doc_id: (r.sections, r.too_big) for r in extraction.read_plan(files, layer, images, budget=100).collect()}
    assert plain[5] == (1, 1) and plain[4] == (1, 0)


def test_a_read_does_not_plan_its_passes_again(spark, tmp_path):
    """What a pass and a verdict return is stored: its plan reads files and joins nothing."""

    def recogniser():
        return lambda name, mime, data, attempt: (data.decode(), "engine", "model")

    rows = [(d, x, "f", f"page {x + 1}", "text/plain", b"words", False, "", x + 1, "") for d in (1, 2) for x in range(3)]
    sections = spark.createDataFrame(
        rows, "doc_id long, idx int, title string, label string, mime string, data binary, too_big boolean, track string, page int, note string"
    )
    plan = plans(spark, (1, 3, False, True), (2, 3, True, True))
    first = reading.read_pass(sections, plan, recogniser, str(tmp_path / "read"), 1)
    second = reading.read_pass(sections, plan, recogniser, str(tmp_path / "read"), 2)
    states = reading.verdicts(second, plan)
    for table in (first, second, states):
        text = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in text and "Aggregate" not in text
    assert second.count() == 6 and {r.state for r in states.collect()} == {"ready"}
