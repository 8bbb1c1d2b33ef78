"""Spark plans against the sequential rules, on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

import models
from poolwright.operators import extraction, graph, grounding, retrieval

WORDS = "lamp wall plate projector cable hdmi the a safety room of lamps 42 über port".split()


def text(rng, paras, longest=12):
    return "\n\n".join(" ".join(rng.choices(WORDS, k=rng.randint(0, longest))) for _ in range(rng.randint(0, paras)))


def test_select_paragraphs(spark):
    """Several questions about each document, over several partition counts."""
    rng = random.Random(1)
    docs = [(k, text(rng, 9)) for k in range(60)]
    asked = [(1, "Which projector lamp?"), (2, ""), (3, "hdmi CABLE port of")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(asked, "question_id long, text string")
    pairs = [(n, k) for n, _ in asked for k in range(60) if (n + k) % 4]
    requests = spark.createDataFrame(pairs, "question_id long, doc_id long")
    for parts in (1, 8):
        rows = retrieval.select_paragraphs(d.repartition(parts), q, requests, 90).collect()
        got = {(r.question_id, r.doc_id): (r.chosen, r.used) for r in rows}
        for n, k in pairs:
            paras = models.split(docs[k][1])
            if paras:
                assert got[(n, k)] == models.select(paras, dict(asked)[n], 90)


def test_with_text(spark):
    rng = random.Random(2)
    docs = [("p", k, text(rng, 9)) for k in range(30)]
    d = spark.createDataFrame(docs, "pool_id string, doc_id long, text string")
    kept = retrieval.with_text(retrieval.leading_text(d, 70), d).collect()
    for r in kept:
        paras = models.split(docs[r.doc_id][2])
        chosen, used = models.select(paras, "", 70)
        assert r.kept == "\n\n".join(paras[i] for i in chosen) and r.used == used == len(r.kept.encode())


DOCS = "pool_id string, seq long, doc_id long, title string, kind string, state string, text string, mime string"


def pool_of(rng, n, ids):
    out = []
    for k in range(n):
        kind = rng.choice(["text", "file", "file"])
        state = "" if kind == "text" else rng.choice(["ready", "ready", "ready", "pending", "failed", ""])
        d = dict(doc_id=next(ids), kind=kind, state=state, text=text(rng, 6), images=[])
        if state == "ready" and rng.random() < 0.4:
            d["images"] = [b"x" * rng.randint(1, 60) for _ in range(rng.randint(1, 3))]
        out.append(d)
    return out


@pytest.mark.parametrize("round_units", [2, 64])
def test_pack_pool(spark, round_units):
    """Whole pools, many questions, rounds so small that several are needed."""
    rng = random.Random(3)
    ids = iter(range(10_000))
    pools = {f"p{k}": pool_of(rng, rng.randint(1, 14), ids) for k in range(12)}
    asked = [(k, f"p{k % 12}", " ".join(rng.choices(WORDS, k=3))) for k in range(30)]
    rows, pics = [], []
    for p, docs in pools.items():
        for k, d in enumerate(docs):
            rows.append((p, k, d["doc_id"], f"t{d['doc_id']}", d["kind"], d["state"], d["text"], "text/plain"))
            pics += [(d["doc_id"], i, i, data) for i, data in enumerate(d["images"])]
    docs = spark.createDataFrame(rows, DOCS)
    images = spark.createDataFrame(pics, "doc_id long, idx int, page int, data binary")
    questions = spark.createDataFrame(asked, "question_id long, pool_id string, text string")
    packed = grounding.pack_pool(grounding.context_units(docs, images), docs, questions, 300, round_units=round_units).cache()
    got = packed.collect()
    for qid, p, question in asked:
        want = models.pack_pool(pools[p], question, 300)
        mine = {(r.doc_id, r.idx): (r.decision, r.sent) for r in got if r.pool_id == p and r.question_id in (None, qid)}
        assert mine == want, (p, question)
    # Notes agree with the decisions, whether a piece is shared or a question's own.
    gaps = grounding.gap_rows(packed, docs)
    notes = {r.question_id: r.note for r in grounding.question_notes(grounding.note_pieces(gaps, 4), questions).collect()}
    for qid, p, question in asked:
        want = models.pack_pool(pools[p], question, 300)
        expect = ""
        for gap, lead in grounding.NOTE_SENTENCES.items():
            names = []
            for d in pools[p]:
                if d["kind"] == "file" and {"pending": "not_read", "failed": "unread"}.get(d["state"]) == gap:
                    names.append(f"t{d['doc_id']}")
                for i in range(-1, len(d["images"])):
                    if want.get((d["doc_id"], i), ("",))[0] == gap:
                        page = f" (image on page {i}).jpg" if i > 0 else " (image).jpg"
                        names.append(f"t{d['doc_id']}" + (page if i >= 0 else ""))
            if names:
                expect += lead + ", ".join(names) + ". "
        assert notes.get(qid, "") == (grounding.NOTE_OPENING + expect + grounding.NOTE_CLOSING if expect else "")


def test_pack_pages_in_blocks(spark):
    """Long files cut into blocks give the sections of a walk over all pages."""
    rng = random.Random(4)
    files = {k: [rng.choice([0, 5, 10, 40, 99, 101, 150]) for _ in range(rng.choice([1, 3, 30, 200, 611]))] for k in range(40)}
    rows = [(k, i + 1, b) for k, sizes in files.items() for i, b in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "doc_id long, page long, bytes long")
    for block in (12, 13, 50, 4096):
        got = {}
        for r in extraction.pack_pages(pages, 100, block=block).collect():
            got.setdefault(r.doc_id, []).append((r.first_page, r.last_page, r.bytes, r.too_big))
        for k, sizes in files.items():
            assert sorted(got[k]) == models.pack_pages(sizes, 100), (k, block)


def test_block_entries_over_two_levels(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 60) for _ in range(3000)]
    pages = spark.createDataFrame([(1, i + 1, b) for i, b in enumerate(sizes)], "doc_id long, page long, bytes long")
    original = extraction._block_entries
    try:
        extraction._block_entries = lambda exits, most: original(exits, most, fan=7)
        got = sorted((r.first_page, r.last_page, r.bytes, r.too_big) for r in extraction.pack_pages(pages, 100, block=20).collect())
    finally:
        extraction._block_entries = original
    assert got == models.pack_pages(sizes, 100)


def read_events(rng, docs, longest):
    out = []
    for k in range(docs):
        for t in range(rng.randint(1, longest)):
            s = rng.choice(["pending", "reading", "ready", "failed", "odd"])
            out.append(
                dict(doc_id=k, t=t, event_id=t, state=s, text="w" * rng.randint(0, 9), source=rng.choice("ab"), model=rng.choice("mn"),
                     engine=rng.choice("ef"), error=rng.choice("xy"), at=rng.randint(1, 9), text_layer=rng.random() < 0.5,
                     done=rng.randint(0, 3), total=rng.randint(0, 3), label=rng.choice("lk"), phase=rng.choice("pq"))
            )
    return out


EVENTS = (
    "doc_id long, t long, event_id long, state string, text string, source string, model string, engine string, "
    "error string, at long, text_layer boolean, done int, total int, label string, phase string"
)


def test_fold_events(spark):
    rng = random.Random(6)
    events = read_events(rng, 120, 9)
    names = [c.split()[0] for c in EVENTS.split(", ")]
    df = spark.createDataFrame([tuple(e[n] for n in names) for e in events], EVENTS)
    got = {r.doc_id: r.asDict() for r in extraction.fold_events(df.repartition(7)).collect()}
    for k in range(120):
        mine = [e for e in events if e["doc_id"] == k]
        want = models.fold_events(mine)
        if not want["state"]:
            assert k not in got
            continue
        assert got[k] == {"doc_id": k, **want}


def test_fold_graphs(spark):
    rng = random.Random(7)
    rows = []
    for k in range(200):
        for t in range(rng.randint(1, 8)):
            rows.append((f"g{k}", t, rng.choice(["ok", "empty", "failed", "manual", "restore"]), f"{k}.{t}", f"key{t}", "n", "m", "e", t + 1))
    df = spark.createDataFrame(
        rows, "graph_id string, t long, kind string, graph string, source_key string, note string, model string, engine string, at long"
    )
    for r in graph.fold_graphs(df).collect():
        want = models.fold_graph([dict(kind=e[2], graph=e[3], source_key=e[4], at=e[8]) for e in rows if e[0] == r.graph_id])
        assert {n: r[n] for n in want} == want
