"""Small worked cases: retrieval, packing, uploads, reads, graphs, conversations."""

from poolwright.operators import chat, extraction, graph, grounding, ingest, pool, recognise, retrieval
from poolwright.sources import tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


LAMP = (
    "The wall plate offers HDMI and VGA.\n\nThe projector lamp must be replaced after 2000 hours; see the lamp counter."
    "\n\nSafety first: unplug everything."
)


def pick(spark, text, question, budget):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    q = spark.createDataFrame([(1, question)], "question_id long, text string")
    r = spark.createDataFrame([(1, 1)], "question_id long, doc_id long")
    return retrieval.with_text(retrieval.select_paragraphs(d, q, r, budget), d).first().kept


def test_relevant_paragraph_wins(spark):
    assert pick(spark, LAMP, "How do I replace the projector lamp?", 90).startswith("The projector lamp")


def test_leading_text_without_question(spark):
    assert pick(spark, "one two three\n\nfour five six\n\nseven", "", 16) == "one two three"


def test_budget_holds(spark):
    kept = pick(spark, "\n\n".join(["lamp and plate equal words"] * 50), "lamp", 300)
    assert 0 < len(kept) <= 300


DOCS = "pool_id string, seq long, doc_id long, title string, kind string, state string, text string, mime string"


def packed(spark, docs, budget, images=None, refs=None):
    d = spark.createDataFrame(docs, DOCS)
    im = spark.createDataFrame(images, "doc_id long, idx int, page int, data binary") if images else None
    rf = spark.createDataFrame(refs, "doc_id long, part string, idx int, ref string") if refs else None
    p = grounding.pack_pool(grounding.context_units(d, im, rf), d, None, budget)
    return d, p


def test_states_are_named(spark):
    docs = [
        ("p", 1, 1, "read.pdf", "file", "ready", "SN 12345", "application/pdf"),
        ("p", 2, 2, "wait.pdf", "file", "pending", "", "application/pdf"),
        ("p", 3, 3, "bad.pdf", "file", "failed", "", "application/pdf"),
    ]
    d, p = packed(spark, docs, 1000)
    assert rows(p, "doc_id", "decision") == [(1, "whole")]
    pieces = grounding.note_pieces(grounding.gap_rows(p, d))
    note = "".join(
        r.fragment for r in sorted(grounding.disclosure_notes(pieces, ["pool_id"]).collect(), key=lambda r: (list(grounding.NOTE_SENTENCES).index(r.gap), r.piece))
    )
    assert note.startswith(grounding.NOTE_OPENING) and note.endswith(grounding.NOTE_CLOSING)
    assert "wait.pdf. " in note and "bad.pdf. " in note


def test_images_and_refs(spark):
    docs = [("p", 1, 1, "manual.pdf", "file", "ready", "text", "application/pdf"), ("p", 2, 2, "", "text", "", "note", "text/markdown")]
    images = [(1, 0, 2, bytearray(b"x" * 30))]
    _, p = packed(spark, docs, 100, images)
    assert rows(p, "path", "decision") == [("document", "whole"), ("manual.pdf", "whole"), ("manual.pdf (image on page 2).jpg", "whole")]
    _, p = packed(spark, docs, 20, images)
    assert ("manual.pdf (image on page 2).jpg", "omitted_image") in rows(p, "path", "decision")
    _, p = packed(spark, docs, 0 + 4, images, [(1, "text", -1, "grave-1")])
    assert rows(p, "doc_id", "part", "decision", "sent") == [(1, "image", "omitted_image", 0), (1, "text", "ref", 0), (2, "text", "whole", 4)]


def test_upload_batch(spark):
    parts = [
        ("b", 0, "layout.png", bytearray(b"\x89PNG\r\n\x1a\n"), 100),
        ("b", 1, "notes.md", bytearray(b"# hi"), 101),
        ("b", 2, "junk.bin", bytearray(b"\x00\x01"), 5),
        ("b", 3, "empty", bytearray(b""), 0),
        ("b", 9, "late.md", bytearray(b"x"), 1),
        ("c", 0, "junk.bin", bytearray(b"\x00\x01"), 5),
    ]
    df = spark.createDataFrame(parts, "batch string, ord long, name string, data binary, size long")
    judged = ingest.judge_uploads(df, most_files=4, most_bytes=100)
    got = {(r.batch, r.ord): (r.accepted, r.reason) for r in judged.collect()}
    assert got[("b", 0)] == (True, "")
    assert got[("b", 1)][1].startswith("is over the")
    assert "application/octet-stream" in got[("b", 2)][1]
    assert got[("b", 3)][1] == "the file is empty"
    assert got[("b", 9)][1] == "skipped — at most 4 files per upload"
    batches = spark.createDataFrame([("b",), ("c",), ("d",)], "batch string")
    out = {r.batch: (r.accepted, r.rejected, r.outcome, r.detail) for r in ingest.batch_outcomes(judged, batches).collect()}
    assert out["b"] == (1, 4, "ok", "") and out["c"][2] == "rejected" and out["c"][3].startswith("junk.bin: files of type")
    assert out["d"] == (0, 0, "nothing", "No files were uploaded")
    assert ingest.pending_documents(judged, "ada", 7).count() == 1


SECTION = "doc_id long, idx int, label string, track string, page int, text string, note string, too_big boolean, err string, model string, engine string"


def test_assembly_names_gaps(spark):
    results = [
        (1, 0, "page 1", "", 0, "first\n\n", "", False, "", "m", "e"),
        (1, 1, "image", "image", 3, "SN 1", "", False, "", "m2", "e2"),
        (1, 2, "page 7", "", 0, "", "", True, "too large", "", ""),
        (1, 3, "whole document", "", 0, "", "", False, "no engine", "", ""),
        (1, 4, "x", "image", 4, "", "an odd image", False, "", "", ""),
        (2, 0, "image", "", 0, "  ", "", False, "", "", ""),
    ]
    df = spark.createDataFrame(results, SECTION)
    whole = "first\n\nImage on page 3:\nSN 1\n\n[page 7: too large to read in one request — this part was not read]\n\n[this file: could not be read: no engine]\n\n[an odd image]"
    for width in (1, 2, 1024):
        parts = sorted(r for r in extraction.assemble_sections(df, width).collect())
        assert "\n\n".join(p.text for p in parts if p.doc_id == 1) == whole
        assert not [p for p in parts if p.doc_id == 2]
    assert rows(extraction.section_summary(df), "doc_id", "any_text", "model", "engine") == [(1, True, "m", "e"), (2, False, "", "")]


def test_interrupted_reads_resume(spark):
    plans = spark.createDataFrame([(1, 4, True), (2, 4, False), (3, 2, False)], "doc_id long, total long, has_text boolean")
    ends = [(d, i, "interrupted" if i == 1 else "read", "outage") for d in (1, 2) for i in range(4)] + [(3, 0, "read", ""), (3, 1, "read", "")]
    df = spark.createDataFrame(ends, "doc_id long, idx long, outcome string, cause string")
    got = {r.doc_id: (r.state, r.done, r.reason) for r in extraction.read_progress(df, plans).collect()}
    assert got[1] == ("ready", 1, "") and got[3] == ("complete", 2, "")
    assert got[2] == ("failed", 1, "The read was interrupted after section 1 of 4 (no AI engine was available). Retry to continue from where it stopped.")
    sections = spark.createDataFrame([(1, 4, i) for i in range(4)] + [(2, 3, i) for i in range(3)], "doc_id long, total long, idx long")
    stored = spark.createDataFrame([(1, 4, 0), (2, 4, 0)], "doc_id long, total long, idx long")
    assert rows(extraction.remaining_work(sections, stored), "doc_id", "idx") == [(1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]


def test_unknown_documents_and_states_do_nothing(spark):
    ev = spark.createDataFrame(
        [(1, 1, 1, "ready", "SN 12345"), (1, 2, 2, "odd", "x"), (9, 1, 3, "ready", "y")], "doc_id long, t long, event_id long, state string, text string"
    ).selectExpr("*", "'text-layer' source", "'' model", "'' engine", "'' error", "5L at", "true text_layer", "0 done", "0 total", "'' label", "'' phase")
    docs = spark.createDataFrame([(1,)], "doc_id long")
    out = extraction.fold_events(ev, docs)
    assert rows(out, "doc_id", "state", "size", "source") == [(1, "ready", 8, "text-layer")]
    assert rows(extraction.last_text(ev.filter("doc_id = 1")), "doc_id", "text") == [(1, "SN 12345")]


def test_tracks(spark):
    local = spark.createDataFrame([(1, "text\n"), (2, "text"), (3, "")], "doc_id long, text string")
    read = spark.createDataFrame(
        [(1, "Image on page 1:\nA", True, "m", "e"), (2, "[gap]", False, "", ""), (3, "B", True, "m", "e")],
        "doc_id long, text string, any_text boolean, model string, engine string",
    )
    assert rows(extraction.merge_tracks(local, read), "doc_id", "text", "source", "model") == [
        (1, "text\n\nImage on page 1:\nA", "mixed", "m"),
        (2, "text\n\n[gap]", "text-layer", ""),
        (3, "B", "ai", "m"),
    ]


def test_graph_sanitised(spark):
    nodes = [("g", 0, " a ", "A", "x" * 20, float("nan"), 30000.0), ("g", 1, "a", "again", "", 0.0, 0.0), ("g", 2, "", "none", "", 0.0, 0.0), ("g", 3, "b", "B", "", -1.0, 5.0), ("g", 4, "c", "C", "", 1.0, 1.0)]
    n = spark.createDataFrame(nodes, "graph_id string, ord long, id string, name string, symbol string, x double, y double")
    clean = graph.sanitise_nodes(n, 4)
    assert rows(clean, "id", "name", "symbol", "x", "y") == [("a", "A", "x" * 16, 0.0, 20000.0), ("b", "B", "", 0.0, 5.0)]
    ports = [("g", o, i, p, "P") for o in range(5) for i, p in enumerate(["1", "1", "", "2"])]
    p = graph.sanitise_ports(spark.createDataFrame(ports, "graph_id string, node_ord long, ord long, id string, name string"), clean, 3)
    assert rows(p, "node", "id") == [("a", "1"), ("b", "1")]
    edges = [("g", 0, "e", "a", "1", "b", "1"), ("g", 1, "e", "b", "1", "a", "1"), ("g", 2, "", "a", "2", "b", "1"), ("g", 3, "", "a", "1", "c", "1"), ("g", 4, "", "a", "1", "b", "1")]
    e = spark.createDataFrame(edges, "graph_id string, ord long, id string, from_node string, from_port string, to_node string, to_port string").selectExpr("*", "'' label")
    out = graph.sanitise_edges(e, p, 5)
    got = rows(out, "ord", "id")
    assert [o for o, _ in got] == [0, 1, 4] and got[0][1] == "e" and len({i for _, i in got}) == 3
    assert rows(graph.distinct_cables(out), "ord") == [(0,)]
    gone = spark.createDataFrame([("g", "b")], "graph_id string, node string")
    assert graph.delete_nodes(out, gone).count() == 0


def test_staleness_sees_changes_behind_the_cut(spark):
    old = spark.createDataFrame([("p", k, 1) for k in range(100)], "pool_id string, doc_id long, created long")
    new = spark.createDataFrame([("p", k, 2 if k == 99 else 1) for k in range(100)], "pool_id string, doc_id long, created long")
    before = graph.source_keys(old)
    assert before.first().source_key == "|".join(sorted(f"{k}:1" for k in range(100)))[:128]
    assert rows(graph.stale(old, before), "stale") == [(False,)]
    assert rows(graph.stale(new, before), "stale") == [(True,)]


def test_conversations(spark):
    base = spark.createDataFrame([("ada", 0, "user", "a"), ("ada", 1, "assistant", "b"), ("grace", 0, "user", "c")], "owner string, turn long, role string, text string")
    none = base.filter("false")
    ada = spark.createDataFrame([("ada",)], "owner string")
    assert rows(chat.replace_by_owner(base, none, ada), "owner") == [("grace",)]
    assert rows(pool.own_rows(base, "ada"), "turn") == [(0,), (1,)]
    prompts = chat.render_prompts(base, "P", "E")
    assert rows(prompts.filter("owner = 'ada'"), "prompt") == [("P\n\nE\n\nUser: a\n\nAssistant: b\n\nAssistant:",)]


def test_answer_retries(spark):
    parts = [(1, 0, "a.md", "text/markdown", "hi", "", "whole"), (1, 1, "b.jpg", "image/jpeg", "..", "", "whole"), (2, 0, "c.md", "text/markdown", "", "old", "ref")]
    schema = "question_id long, ord long, path string, media_type string, content string, ref string, decision string"
    p = spark.createDataFrame(parts, schema)
    prompts = spark.createDataFrame([(1, "one"), (2, "two")], "question_id long, prompt string")
    notes = spark.createDataFrame([(1, "left out")], "question_id long, note string")

    def model():
        def ask(prompt, rows):
            if any(r["media_type"].startswith("image/") for r in rows):
                raise ValueError("no vision engine")
            if any(r["ref"] for r in rows):
                raise ValueError("stale")
            return ",".join(r["path"] for r in rows), "m", "e", {}

        return ask

    first = recognise.answer(grounding.with_notes(p, notes), prompts, model)
    assert rows(first, "question_id", "output", "error") == [(1, "grounding-note,grounding-note,a.md", ""), (2, "", "stale")]
    due = spark.createDataFrame([(1, False), (2, True)], "question_id long, retry_due boolean")
    full = spark.createDataFrame([(2, 0, "c.md", "text/markdown", "full", "", "whole")], schema)
    done = recognise.retry_in_full(first, due, full, prompts, model)
    assert rows(done, "question_id", "output") == [(1, "grounding-note,grounding-note,a.md"), (2, "c.md")]


def test_missing_recogniser_is_named(spark):
    s = spark.createDataFrame([(1, 0, "f", "page 1", "application/pdf", bytearray(b"x"))], "doc_id long, idx int, title string, label string, mime string, data binary")
    s = s.selectExpr("*", "false too_big", "'' track", "1 page", "'' note")
    assert rows(recognise.read_sections(s, None), "doc_id", "err") == [(1, recognise.NO_RECOGNISER)]


def test_pool_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(
        [("p", 1, 1, "t", "text", "text/markdown", None, "c", 1, "ada", 5), ("q", 2, 2, None, "file", "", "", "", 2, "", 6)], tables.DOCUMENTS
    )
    tables.write_pool(docs, str(tmp_path / "pool"))
    back = tables.read_pool(spark, str(tmp_path / "pool"))
    assert rows(back, "doc_id", "title", "description") == [(1, "t", ""), (2, "", "")]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "notes.md").write_bytes(b"# hi")
    assert rows(tables.read_files(spark, str(tmp_path / "up" / "*")), "name", "size") == [("notes.md", 4)]
