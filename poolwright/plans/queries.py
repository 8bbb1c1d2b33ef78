"""The registered queries: each runs one operator over whole tables.

Lists and binaries are turned into text in the last step, so that results compare as plain
columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwright.functions import files as ff
from poolwright.functions import text as ft
from poolwright.operators import chat, extraction, graph, grounding, ingest, pool, reading, recognise, retrieval, term_index, turn
from poolwright.plans import inputs as i
from poolwright.session import materialize, run_folder, scratch_folder
from poolwright.sources import tables
from poolwright.streaming import jobs

DELIMITER = "\n"
PARAGRAPH_BUDGET = 600
POOL_BUDGET = 20_000
NOW = 1_704_200_000
JOBS_NOW = 1_706_600_000


def _ids(c: str | Column) -> Column:
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c, ",")


# Sources, sinks and views


def load_pool_documents(s: SparkSession, d: str) -> DataFrame:
    """The derived pool, written by pool to the shared folder and loaded from there."""
    path = f"{run_folder(s)}/{uuid.uuid4().hex}"
    docs = i.pool_docs(s, d)
    tables.write_pool(
        docs.select(
            "pool_id", "seq", "doc_id", "title", "kind", "mime", F.col("state").alias("description"), F.col("text").alias("content"),
            ft.byte_len("text").alias("size"), F.lit(None).cast("string").alias("author"), F.col("created").cast("long").alias("created"),
        ),
        path,
    )
    loaded = tables.read_pool(s, path)
    return loaded.select("pool_id", "seq", "doc_id", "title", "kind", F.col("description").alias("state"), ft.byte_len("content").alias("size"))


def read_uploaded_files(s: SparkSession, d: str) -> DataFrame:
    return i.uploads(s, d).select("batch", "ord", F.col("size").cast("long").alias("size"), F.md5("data").alias("digest"))


def _batch_of(path: str) -> Column:
    return F.regexp_extract(path, "batch=([0-9]+)", 1).cast("long").alias("batch")


def read_stored_files(s: SparkSession, d: str) -> DataFrame:
    """Every batch of pages as a file of the shared folder, read back through ``read_files``."""
    files = tables.read_files(s, f"{i.stored_files(s, d)}/batch=*")
    return files.select(_batch_of("path"), "size", F.md5("data").alias("digest"))


def extract_view(s: SparkSession, d: str) -> DataFrame:
    docs = i.pool_docs(s, d)
    state = docs.filter(F.col("kind") == "file").select("doc_id", "state")
    text = docs.filter(F.col("state") == "ready").select("doc_id", "text")
    view = pool.extract_view(docs, state, text)
    return view.select("pool_id", "doc_id", "title", "state", F.md5("text").alias("text_digest"))


def apply_changes(s: SparkSession, d: str) -> DataFrame:
    base = i.table(s, d, "documents").select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"))
    log = i.table(s, d, "events").select(
        F.col("user_id").alias("doc_id"),
        F.col("event_type").alias("source"),
        F.get_json_object("props", "$.k").cast("long").alias("n_chars"),
        F.col("ts").alias("t"),
        "event_id",
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
    )
    return pool.apply_changes(base, log, "doc_id", ["t", "event_id"])


def replace_by_owner(s: SparkSession, d: str) -> DataFrame:
    base = i.messages(s, d).select("owner", "turn", "role", "text")
    owners = base.filter(F.col("role") == "system").select("owner")
    new = base.filter(F.col("role") == "user").withColumn("text", F.concat(F.lit("new "), "text"))
    path = f"{run_folder(s)}/{uuid.uuid4().hex}"
    tables.write_owned(base, path)
    tables.replace_owned(s, path, new, owners)
    return tables.read_owned(s, path)


def cascade_delete(s: SparkSession, d: str) -> DataFrame:
    gone = i.table(s, d, "events").filter(F.col("event_type") == "error").select(F.col("user_id").alias("doc_id"))
    tables = {"text": i.table(s, d, "documents").select("doc_id"), "label": i.table(s, d, "labels").select("doc_id")}
    left = pool.cascade_delete(tables, gone)
    return left["text"].withColumn("kept_in", F.lit("text")).unionByName(left["label"].withColumn("kept_in", F.lit("label")))


# Scalars


def upload_kind(s: SparkSession, d: str) -> DataFrame:
    k = i.uploads(s, d).select("ord", ff.upload_kind("name", "data").alias("k"))
    return k.select("ord", "k.mime", "k.reason")


def text_type(s: SparkSession, d: str) -> DataFrame:
    return i.uploads(s, d).select("ord", ff.text_type("name").alias("mime"))


def clean_name(s: SparkSession, d: str) -> DataFrame:
    return i.uploads(s, d).select("ord", ff.clean_name("name").alias("name"))


def clip_bytes(s: SparkSession, d: str) -> DataFrame:
    return i.table(s, d, "documents").select("doc_id", ft.clip("text", 200).alias("clipped"))


def with_ending(s: SparkSession, d: str) -> DataFrame:
    mime = F.element_at(F.array(*[F.lit(m) for m in [*ff.ENDINGS, "text/plain"]]), (F.col("page_id") % 6 + 1).cast("int"))
    name = F.concat("url", F.when(F.col("page_id") % 12 < 6, F.upper(ff.ending_for(mime))).otherwise(""))
    return i.table(s, d, "pages").select("page_id", ff.with_ending(name, mime).alias("name"))


def coherent(s: SparkSession, d: str) -> DataFrame:
    texts = i.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(
        i.table(s, d, "conversations").select(
            (F.lit(-1) - F.col("conv_id") * 1000 - F.col("turn")).alias("id"),
            F.translate("text", "e", "\x01").alias("text"),
        )
    )
    return texts.select("id", ft.coherent("text").alias("coherent"))


def squeeze_blank_lines(s: SparkSession, d: str) -> DataFrame:
    spread = F.replace("text", F.lit(". "), F.lit(". \n\t\n \n"))
    return i.table(s, d, "documents").select("doc_id", F.md5(ft.squeeze_blank_lines(spread)).alias("digest"))


def strip_bom(s: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.when(F.col("doc_id") % 2 == 0, "﻿").otherwise(""), F.col("text"))
    return i.table(s, d, "documents").select("doc_id", F.md5(ft.strip_bom(marked)).alias("digest"))


def error_kind(s: SparkSession, d: str) -> DataFrame:
    texts = i.table(s, d, "documents").select(F.lit("d").alias("of"), F.col("doc_id").alias("id"), "text").unionByName(
        i.table(s, d, "pages").select(F.lit("p").alias("of"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    )
    shown = ft.error_message("text", "server error", "server timeout")
    return texts.select("of", "id", ft.error_kind("text").alias("kind"), F.md5(shown).alias("digest"))


def permitted(s: SparkSession, d: str) -> DataFrame:
    grants = i.table(s, d, "customer").select(
        F.col("c_custkey").alias("owner"),
        F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"),
        F.col("c_mktsegment").alias("member_of"),
    )
    return pool.permitted(i.messages(s, d), grants, "MACHINERY").select("owner", "turn", "role")


def own_rows(s: SparkSession, d: str) -> DataFrame:
    return pool.own_rows(i.messages(s, d), 7).select("owner", "turn", "role")


def failure_reasons(s: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    outcome = F.when((flag == "R") & (F.col("l_quantity") > 49), "too_big").when(flag == "R", "too_slow").otherwise("read")
    lines = i.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), outcome.alias("outcome"))
    return extraction.no_text_reason(lines)


def failure_sentences(s: SparkSession, d: str) -> DataFrame:
    """What a failed read, a failed turn and an interruption are reported as."""
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.element_at(F.array(*[F.lit(c) for c in ("no_ai", "too_large", "unavailable", "no_bytes", "disabled", "outage", "timeout", "other")]), k % 8 + 1)
    events = i.table(s, d, "events").select("event_id", k.alias("k"), code.alias("code"))
    return events.select(
        "event_id",
        extraction.read_failure(F.col("code")).alias("read"),
        extraction.ask_failure(F.col("code")).alias("asked"),
        extraction.interruption(F.col("k") % 5, F.lit(5), F.col("code")).alias("stopped"),
    )


def author_text(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    posts = i.table(s, d, "documents").select(
        k.alias("post_id"),
        F.when(k % 7 == 0, " 　").otherwise(F.concat(F.lit("\t doc "), k.cast("string"), F.lit(" "))).alias("title"),
        F.when(k % 11 == 0, "\n").otherwise(F.col("text")).alias("content"),
        F.concat(F.lit(" "), F.col("lang")).alias("description"),
        F.col("source").alias("author"),
        F.lit(NOW).alias("created"),
    )
    out = pool.author_text(posts)
    return out.withColumn("content", F.md5("content")).withColumn("created", F.col("created").cast("long"))


# Reading files


def _state(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "state", "source", "model", "engine", "error", "size", "at", "text_layer",
        F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"), "label", "phase",
    )


def fold_events(s: SparkSession, d: str) -> DataFrame:
    ev = i.extract_events(i.table(s, d, "events"))
    return _state(extraction.fold_events(ev, i.table(s, d, "documents"), ("t", "event_id")))


def to_resume(s: SparkSession, d: str) -> DataFrame:
    ev = i.extract_events(i.table(s, d, "events"))
    return extraction.to_resume(extraction.fold_events(ev, order=("t", "event_id"))).select("doc_id", "state")


def last_text(s: SparkSession, d: str) -> DataFrame:
    ev = i.extract_events(i.table(s, d, "events"))
    return extraction.last_text(ev, ("t", "event_id")).select("doc_id", ft.byte_len("text").alias("bytes"))


def resume_kept(s: SparkSession, d: str) -> DataFrame:
    state = extraction.fold_events(i.extract_events(i.table(s, d, "events")), order=("t", "event_id"))
    stored = i.table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("idx")).distinct()
    return extraction.resume_kept(state, stored).select("doc_id", F.col("idx").cast("long").alias("idx"))


def read_plan(s: SparkSession, d: str) -> DataFrame:
    p = i.table(s, d, "pages")
    mime = F.element_at(
        F.array(*[F.lit(m) for m in ("text/html", "image/png", "application/pdf", "application/pdf", "image/gif", "application/zip")]),
        (F.col("page_id") % 6 + 1).cast("int"),
    )
    files = p.select(F.col("page_id").alias("doc_id"), mime.alias("mime"), F.octet_length("html").alias("bytes"))
    layer = p.select(F.col("page_id").alias("doc_id"), (ft.coherent("html") & (F.col("page_id") % 5 < 3)).alias("coherent"))
    images = i.table(s, d, "lineitem").select((F.col("l_suppkey") * 2).alias("doc_id"), F.col("l_partkey").alias("idx"))
    # A supplier's order lines are the pages of one file without text and pictures of its own.
    pages = i.pages_of_files(s, d).select((F.col("doc_id") * 6 - 3).alias("doc_id"), "page", (F.col("bytes") * 50).alias("bytes"))
    return extraction.read_plan(files, layer, images, pages, 2000)


def pack_pages(s: SparkSession, d: str) -> DataFrame:
    return extraction.pack_pages(i.pages_of_files(s, d), 200)


def pack_long_files(s: SparkSession, d: str) -> DataFrame:
    """The same packing with blocks far shorter than a file, as a very long file would have."""
    return extraction.pack_pages(i.pages_of_files(s, d), 45, block=64)


def distinct_images(s: SparkSession, d: str) -> DataFrame:
    return extraction.distinct_images(i.image_refs(s, d))


def image_labels(s: SparkSession, d: str) -> DataFrame:
    out = extraction.image_labels(extraction.distinct_images(i.image_refs(s, d)))
    return out.select("doc_id", "object", "label")


def section_outcomes(s: SparkSession, d: str) -> DataFrame:
    return extraction.section_outcomes(i.attempts(i.table(s, d, "events")), ["t", "event_id"])


def read_progress(s: SparkSession, d: str) -> DataFrame:
    return extraction.read_progress(i.section_ends(s, d), i.supplier_plans(s, d))


def final_state(s: SparkSession, d: str) -> DataFrame:
    # Orders stand for short files: few sections, so that every closing rule occurs.
    flag, size = F.col("l_returnflag"), F.col("l_quantity")
    lines = i.table(s, d, "lineitem")
    outcome = (
        F.when(size > 48, "too_big").when(size == 1, "interrupted").when(flag == "R", "too_slow").when(flag == "A", "note").otherwise("read")
    )
    results = lines.select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") - 1).alias("idx"),
        outcome.alias("outcome"),
        (outcome == "read").alias("legible"),
        F.lit("outage").alias("cause"),
    )
    n = results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("places"))
    plans = i.table(s, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        (F.col("o_orderstatus") == "F").alias("has_text"),
        (F.col("o_orderpriority") != "1-URGENT").alias("has_ai"),
        F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0).alias("extra"),
    ).join(n, "doc_id", "left").select(
        "doc_id", "has_text", "has_ai", (F.coalesce("places", F.lit(0)) + F.when(F.col("n") > 3, F.col("extra")).otherwise(0)).alias("total")
    )
    return extraction.final_state(plans, results)


def remaining_work(s: SparkSession, d: str) -> DataFrame:
    lines = i.lines(s, d)
    n = lines.groupBy("doc_id").agg(F.max("page").alias("total"))
    idx = (F.col("page") - 1).alias("idx")
    sections = lines.select("doc_id", idx).join(n, "doc_id")
    stored = lines.filter(F.col("l_returnflag") != "R").select("doc_id", idx).join(n, "doc_id").withColumn(
        "total", F.when(F.col("doc_id") % 5 == 0, F.col("total") + 1).otherwise(F.col("total"))
    )
    return extraction.remaining_work(sections, stored).select("doc_id", "idx", "total")


def assemble_sections(s: SparkSession, d: str) -> DataFrame:
    parts = extraction.assemble_sections(i.section_results(s, d), 256)
    return parts.select("doc_id", "part", ft.byte_len("text").alias("bytes"), F.md5("text").alias("digest"))


def section_summary(s: SparkSession, d: str) -> DataFrame:
    return extraction.section_summary(i.section_results(s, d))


def merge_tracks(s: SparkSession, d: str) -> DataFrame:
    docs, labels = i.table(s, d, "documents"), i.table(s, d, "labels")
    local = docs.select("doc_id", F.when(F.col("lang") == "de", "").otherwise(F.concat("text", F.lit("\n\n"))).alias("text"))
    read = labels.select(
        "doc_id",
        F.when(F.col("quality") == 1, F.concat(F.lit("Image on page 1:\n"), F.col("doc_id").cast("string"))).when(F.col("toxic") == 1, " ").otherwise("[gap]").alias("text"),
        (F.col("quality") == 1).alias("any_text"),
        F.when(F.col("quality") == 1, "m").alias("model"),
        F.when(F.col("quality") == 1, "e").alias("engine"),
    )
    return extraction.merge_tracks(local, read).withColumn("text", F.md5("text"))


# Retrieval


def split_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return retrieval.split_paragraphs(i.pool_texts(s, d), DELIMITER).select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("para").alias("digest"))


def query_terms(s: SparkSession, d: str) -> DataFrame:
    asked = i.questions(s, d).select(F.lit("b").alias("of"), F.col("question_id").alias("id"), "text").unionByName(
        i.table(s, d, "conversations").filter(F.col("role") == "user").select(
            F.lit("c").alias("of"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
        )
    )
    return asked.select("of", "id", _ids(F.sort_array(ft.query_terms("text"))).alias("terms"))


def paragraph_scores(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.paragraph_scores(i.pool_texts(s, d), i.questions(s, d), i.requests(s, d), DELIMITER)
    return out.select("question_id", "doc_id", F.col("idx").cast("long").alias("idx"), F.col("score").cast("long").alias("score"))


def indexed_scores(s: SparkSession, d: str) -> DataFrame:
    path = f"{run_folder(s)}/index-{uuid.uuid4().hex}"
    term_index.write_index(i.pool_texts(s, d), path, DELIMITER)
    out = term_index.indexed_scores(term_index.read_index(s, path), i.questions(s, d), i.requests(s, d))
    return out.select("question_id", "doc_id", F.col("idx").cast("long").alias("idx"), F.col("score").cast("long").alias("score"))


def rank_paragraphs(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.rank_paragraphs(i.pool_texts(s, d), i.questions(s, d), i.requests(s, d), DELIMITER)
    return out.select("question_id", "doc_id", F.col("idx").cast("long").alias("idx"), F.col("place").cast("long").alias("place"))


def select_paragraphs(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.select_paragraphs(
        i.pool_texts(s, d), i.questions(s, d), i.requests(s, d), PARAGRAPH_BUDGET, DELIMITER
    )
    return out.select("question_id", "doc_id", "used", _ids("chosen").alias("chosen"))


def leading_text(s: SparkSession, d: str) -> DataFrame:
    docs = i.pool_texts(s, d)
    out = retrieval.with_text(retrieval.leading_text(docs, PARAGRAPH_BUDGET, DELIMITER), docs, DELIMITER)
    return out.select("doc_id", "used", F.md5("kept").alias("digest"))


# Context


def _packed(s: SparkSession, d: str, asked: bool = True, refs: bool = False) -> DataFrame:
    docs = i.pool_docs(s, d)
    units = grounding.context_units(docs, i.pool_images(s, d), i.part_refs(s, d) if refs else None, DELIMITER)
    return grounding.pack_pool(units, docs, i.questions(s, d) if asked else None, POOL_BUDGET, DELIMITER)


def pack_pool(s: SparkSession, d: str) -> DataFrame:
    out = _packed(s, d)
    return out.select("question_id", "pool_id", "doc_id", F.col("idx").cast("long").alias("idx"), "decision", "sent", _ids("chosen").alias("chosen"))


def pack_with_refs(s: SparkSession, d: str) -> DataFrame:
    out = _packed(s, d, asked=False, refs=True)
    return out.select("pool_id", "doc_id", F.col("idx").cast("long").alias("idx"), "decision", "sent", F.coalesce("ref", F.lit("")).alias("ref"))


def gap_rows(s: SparkSession, d: str) -> DataFrame:
    out = grounding.gap_rows(_packed(s, d), i.pool_docs(s, d))
    return out.select("question_id", "pool_id", "path", "gap")


def disclosure_notes(s: SparkSession, d: str) -> DataFrame:
    gaps = grounding.gap_rows(_packed(s, d, asked=False), i.pool_docs(s, d))
    return grounding.disclosure_notes(grounding.note_pieces(gaps, 100).drop("question_id"), ["pool_id"])


def note_pieces(s: SparkSession, d: str) -> DataFrame:
    return grounding.note_pieces(grounding.gap_rows(_packed(s, d), i.pool_docs(s, d)), 100)


def context_counts(s: SparkSession, d: str) -> DataFrame:
    return grounding.context_counts(_packed(s, d), i.questions(s, d))


def _parts(s: SparkSession, d: str) -> DataFrame:
    return grounding.context_parts(_packed(s, d), i.questions(s, d)).withColumn("ord", F.col("seq") * 1000 + F.col("sub"))


def _content(s: SparkSession, d: str) -> DataFrame:
    return grounding.with_content(_parts(s, d), i.pool_docs(s, d), i.pool_images(s, d), DELIMITER)


def context_content(s: SparkSession, d: str) -> DataFrame:
    return _content(s, d).select("question_id", "ord", "path", "media_type", ft.byte_len("content").alias("bytes"), F.md5("content").alias("digest"))


def text_only(s: SparkSession, d: str) -> DataFrame:
    parts = _content(s, d)
    return grounding.text_only(parts).select("question_id", "ord", "path", "media_type", F.md5("content").alias("digest"))


def uses_refs(s: SparkSession, d: str) -> DataFrame:
    return grounding.uses_refs(_packed(s, d, refs=True), i.questions(s, d))


def remember_refs(s: SparkSession, d: str) -> DataFrame:
    parts = _parts(s, d)
    # Titles that collide: many documents share the same one.
    same = F.when(F.col("part") == "image", F.col("path")).otherwise(F.concat(F.lit("title "), (F.col("doc_id") % 40).cast("string")))
    parts = parts.withColumn("path", same)
    returned = parts.select("question_id", "ord", "path", F.when(F.col("doc_id") % 4 == 3, "").otherwise(F.concat_ws("-", F.lit("g"), "question_id", "ord")).alias("ref"))
    return grounding.remember_refs(parts, returned).select("doc_id", "part", F.col("idx").cast("long").alias("idx"), "ref")


def invalidate_refs(s: SparkSession, d: str) -> DataFrame:
    gone = i.table(s, d, "events").filter(F.col("event_type") == "error").select(F.col("user_id").alias("doc_id"))
    return grounding.invalidate_refs(i.part_refs(s, d), gone).select("doc_id", "part", "ref")


def display_paths(s: SparkSession, d: str) -> DataFrame:
    titles = i.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, " \t").otherwise(F.concat(F.lit(" "), F.col("source"), F.lit("\n"))).alias("title"))
    return titles.select("doc_id", ft.display_path("title").alias("path"), ft.image_path("title", F.col("doc_id") % 4).alias("image"))


# Graphs


def _graph(df: DataFrame) -> DataFrame:
    return df.withColumns({"doc": F.coalesce("doc", F.lit("")), "current": F.coalesce("current", F.lit(""))})


def fold_graphs(s: SparkSession, d: str) -> DataFrame:
    return _graph(graph.fold_graphs(i.graph_events(i.table(s, d, "events")), ("t", "event_id")))


def parse_answers(s: SparkSession, d: str) -> DataFrame:
    return graph.parse_answers(i.model_answers(s, d)).select(
        "graph_id", "usable", "note", F.size("nodes").cast("long").alias("nodes"), F.size("edges").cast("long").alias("edges")
    )


def answer_elements(s: SparkSession, d: str) -> DataFrame:
    parsed = graph.parse_answers(i.model_answers(s, d))
    nodes = graph.answer_nodes(parsed).select("graph_id", F.lit("node").alias("what"), F.concat_ws("|", "ord", "id", "name", "symbol").alias("value"), F.coalesce("x", F.lit(0.0)).alias("x"))
    ports = graph.answer_ports(parsed).select("graph_id", F.lit("port").alias("what"), F.concat_ws("|", "node_ord", "ord", "id", "name").alias("value"), F.lit(0.0).alias("x"))
    edges = graph.answer_edges(parsed).select("graph_id", F.lit("edge").alias("what"), F.concat_ws("|", "ord", "from_node", "from_port", "to_node", "to_port", "label").alias("value"), F.lit(0.0).alias("x"))
    return nodes.unionByName(ports).unionByName(edges)


NODES, PORTS, EDGES = 50, 4, 600


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.sanitise_nodes(i.graph_nodes(s, d), NODES)


def _ports(s: SparkSession, d: str) -> DataFrame:
    return graph.sanitise_ports(i.graph_ports(i.graph_nodes(s, d)), _nodes(s, d), PORTS)


def sanitise_nodes(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).select("graph_id", "id", "ord", "name", "symbol", "x", "y")


def sanitise_ports(s: SparkSession, d: str) -> DataFrame:
    return _ports(s, d).select("graph_id", "node", "id", F.col("ord").cast("long").alias("ord"), "name")


def sanitise_edges(s: SparkSession, d: str) -> DataFrame:
    e = graph.sanitise_edges(i.graph_edges(s, d), _ports(s, d), EDGES)
    return e.select("graph_id", "ord", "from_node", "from_port", "to_node", "to_port", "label")


def edge_ids(s: SparkSession, d: str) -> DataFrame:
    return graph.renew_ids(i.graph_edges(s, d)).select("graph_id", "ord", "id")


def source_keys(s: SparkSession, d: str) -> DataFrame:
    return graph.source_keys(i.pool_docs(s, d))


def stale_graphs(s: SparkSession, d: str) -> DataFrame:
    docs = i.pool_docs(s, d)
    # Every graph was derived before the documents of the highest quality came in.
    early = docs.filter(F.col("state") != "ready")
    return graph.stale(docs, graph.source_keys(early))


def delete_nodes(s: SparkSession, d: str) -> DataFrame:
    gone = i.graph_nodes(s, d).filter(F.col("y") > 0).select("graph_id", ft.trim_space("id").alias("node"))
    return graph.delete_nodes(i.graph_edges(s, d), gone).select("graph_id", "ord", "from_node", "to_node")


def distinct_cables(s: SparkSession, d: str) -> DataFrame:
    e = i.graph_edges(s, d)
    odd = F.col("ord") % 2 == 1
    # Every other edge is drawn the other way round, and ports are few, so that cables repeat.
    turned = e.select(
        "graph_id", "ord", "id", "label",
        F.when(odd, F.col("from_node")).otherwise(F.col("to_node")).alias("from_node"),
        F.lit("1").alias("from_port"),
        F.when(odd, F.col("to_node")).otherwise(F.col("from_node")).alias("to_node"),
        F.lit("1").alias("to_port"),
    )
    return graph.distinct_cables(turned).select("graph_id", "ord", "from_node", "to_node")


def generation_outcomes(s: SparkSession, d: str) -> DataFrame:
    ev = i.table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    attempts = ev.select(
        F.col("event_id").alias("attempt_id"),
        F.col("user_id").alias("graph_id"),
        F.when(kind == "click", " ok ").when(kind == "view", "").when(kind == "error", "failed").when(kind == "signup", "odd").otherwise("ok").alias("state"),
        F.concat(F.lit(" "), F.repeat(F.lit("n"), k * 40)).alias("note"),
        F.repeat(F.lit("m"), k * 2).alias("model"),
        F.lit(None).cast("string").alias("engine"),
        F.repeat(F.lit("k"), k * 3).alias("source_key"),
    )
    # Every attempt has a count; further rows name attempts that no event has.
    counts = ev.select(F.col("event_id").alias("attempt_id"), (k % 8).alias("n"))
    counts = counts.unionByName(counts.select((-1 - F.col("attempt_id")).alias("attempt_id"), "n"))
    return graph.generation_outcomes(attempts, counts)


# Conversations and jobs


def sanitise_transcript(s: SparkSession, d: str) -> DataFrame:
    return chat.sanitise_transcript(i.messages(s, d), NOW, 5, 200)


def render_prompts(s: SparkSession, d: str) -> DataFrame:
    kept = chat.sanitise_transcript(i.messages(s, d), NOW, 5)
    counts = i.table(s, d, "labels").select(F.col("doc_id").alias("owner"), F.col("quality").alias("n"))
    return chat.render_prompts(kept, "You help.", "The room is empty.", counts).select("owner", F.md5("prompt").alias("digest"))


def latest_jobs(s: SparkSession, d: str) -> DataFrame:
    ev = i.table(s, d, "events")
    kind = F.col("event_type")
    state = F.when(kind == "error", "failed").when(kind == "purchase", "done").otherwise("running")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    log = ev.select(
        F.col("user_id").alias("job_id"), F.col("ts").alias("t"), "event_id", state.alias("state"),
        F.when(state == "running", F.lit(0)).otherwise(at).cast("long").alias("done"),
    )
    return pool.latest_jobs(log, JOBS_NOW, 3 * 86_400, ("t", "event_id")).select("job_id", "state", "done")


def judge_uploads(s: SparkSession, d: str) -> DataFrame:
    return ingest.judge_uploads(i.uploads(s, d), most_bytes=4000)


def batch_outcomes(s: SparkSession, d: str) -> DataFrame:
    # Batches of three so that refused batches occur; as many batches again have no part at all.
    parts = i.uploads(s, d).withColumn("batch", F.floor(F.col("ord") / 3))
    batches = parts.select("batch").distinct()
    empty = batches.select((-1 - F.col("batch")).alias("batch"))
    return ingest.batch_outcomes(ingest.judge_uploads(parts, 2, 4000), batches.unionByName(empty))


def newest_first(s: SparkSession, d: str) -> DataFrame:
    return pool.newest_first(i.pool_docs(s, d).select("doc_id", "created", "title"), 100)


# Python plug points, with a deterministic stand-in


def _reader() -> Callable:
    def read(name: str, mime: str, data: bytes) -> tuple[str, str, str]:
        if len(data) % 7 == 0:
            raise ValueError("unreadable")
        return f"{name}:{len(data)}", "engine", "model"

    return read


def read_sections(s: SparkSession, d: str) -> DataFrame:
    up = i.uploads(s, d)
    sections = up.select(
        F.col("ord").alias("doc_id"), F.lit(0).alias("idx"), F.concat(F.lit("f"), F.col("ord").cast("string")).alias("title"),
        F.when(F.col("ord") % 3 == 0, "page 1").otherwise("whole document").alias("label"), F.lit("application/pdf").alias("mime"),
        "data", (F.col("size") > 9000).alias("too_big"), F.lit("").alias("track"), F.lit(1).alias("page"),
        F.when(F.col("ord") % 11 == 0, "a note").alias("note"),
    )
    return recognise.read_sections(sections, _reader).select("doc_id", "text", "note", "too_big", "err", "model")


def _model() -> Callable:
    def ask(prompt: str, parts: list[dict]) -> tuple[str, str, str, dict]:
        if any(p["media_type"].startswith("image/") for p in parts) and len(prompt) % 2:
            raise ValueError("no vision engine")
        if len(prompt) % 5 == 0:
            raise ValueError("unavailable")
        size = sum(len(p["content"].encode()) for p in parts)
        return f"{len(prompt)}:{len(parts)}:{size}", "model", "engine", {p["path"]: "r" for p in parts[:1]}

    return ask


def answer_questions(s: SparkSession, d: str) -> DataFrame:
    asked = i.questions(s, d)
    parts = _content(s, d).withColumn("ref", F.coalesce("ref", F.lit("")))
    prompts = asked.select("question_id", F.col("text").alias("prompt"))
    out = recognise.answer(parts, prompts, _model)
    return out.select("question_id", "output", "error", F.size("refs").cast("long").alias("refs"))


def _forgetful() -> Callable:
    """Sees no pictures for some questions, has lost what it held for others, and returns a reference for every part."""

    def ask(prompt: str, parts: list[dict]) -> tuple[str, str, str, dict]:
        refs = sum(p["ref"] != "" for p in parts)
        if any(p["media_type"].startswith("image/") for p in parts) and len(prompt) % 2:
            raise ValueError("no vision engine")
        if refs and len(prompt) % 3 == 0:
            raise ValueError("stale reference")
        if len(prompt) % 5 == 0:
            raise ValueError("unavailable")
        size = sum(len(p["content"].encode()) for p in parts)
        held = {p["path"]: f"r:{p['path']}" for p in parts if p["path"] != grounding.NOTE_PATH}
        return f"{len(prompt)}:{len(parts)}:{size}:{refs}", "model", "engine", held

    return ask


def _turns(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = i.questions(s, d)
    path = f"{scratch_folder(s)}/{uuid.uuid4().hex}"
    return turn.ask_turns(i.pool_docs(s, d), i.pool_images(s, d), [asked, asked], _forgetful, path, budget=POOL_BUDGET, delimiter=DELIMITER)


def ask_turns(s: SparkSession, d: str) -> DataFrame:
    return _turns(s, d)[0].select("turn", "question_id", "output", "error", F.size("refs").cast("long").alias("refs"))


def ref_ledger(s: SparkSession, d: str) -> DataFrame:
    return _turns(s, d)[1].select("doc_id", "part", F.col("idx").cast("long").alias("idx"), "ref")


def _unsteady(first: bool) -> Callable:
    """Reads pages of order lines; the engine is out for some in the first pass, some are slow, some unreadable."""

    def recogniser() -> Callable:
        def read(name: str, mime: str, data: bytes, attempt: int) -> tuple[str, str, str]:
            flag, size, text = data.decode().split("|", 2)
            if flag == "R" and float(size) <= 2 and first:
                raise ConnectionError("no engine")
            if flag == "R" and (float(size) <= 10 or float(size) <= 20 and not attempt):
                raise TimeoutError("too slow")
            if flag == "A" and float(size) > 45:
                raise ValueError("unreadable")
            return text, "engine", "model"

        return read

    return recogniser


def read_files(s: SparkSession, d: str) -> DataFrame:
    """Two passes over the pages of supplier files; the first is cut off by outages."""
    part = i.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    size = F.col("p_size")
    sections = i.lines(s, d).join(part, "l_partkey").select(
        "doc_id", (F.col("page") - 1).alias("idx"), F.lit("file").alias("title"), F.concat(F.lit("page "), F.col("page").cast("string")).alias("label"),
        F.lit("application/pdf").alias("mime"), F.concat_ws("|", "l_returnflag", F.col("l_quantity").cast("string"), "p_name").cast("binary").alias("data"),
        (size == 2).alias("too_big"), F.when(F.col("l_linestatus") == "O", "image").otherwise("").alias("track"), "page",
        F.when(size == 1, "not decoded").alias("note"),
    )
    sections, plans = materialize(sections), materialize(i.supplier_plans(s, d))
    path = f"{scratch_folder(s)}/{uuid.uuid4().hex}"
    once = reading.read_pass(sections, plans, _unsteady(True), path, 1)
    before = reading.verdicts(once, plans).select("doc_id", F.col("state").alias("state1"), F.col("done").alias("done1"), "reason")
    twice = reading.read_pass(sections, plans, _unsteady(False), path, 2)
    states = reading.verdicts(twice, plans)
    local = plans.filter("has_text").select("doc_id", F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit("\n")).alias("text"))
    parts = reading.texts(twice, plans, local, states, 256)
    sizes = parts.groupBy("doc_id").agg((F.sum(ft.byte_len("text")) + 2 * (F.count(F.lit(1)) - 1)).alias("bytes"), F.max("source").alias("source"))
    counts = twice.groupBy("doc_id").agg(F.count_if(F.col("pass") == 1).alias("read1"), F.count_if(F.col("pass") == 2).alias("read2"))
    return (
        states.join(before, "doc_id").join(sizes, "doc_id", "left").join(counts, "doc_id", "left")
        .select("doc_id", "state1", "done1", before["reason"].alias("reason1"), "state", "done", "total", "read1", "read2", "source", "bytes")
    )


# Streams: the whole event table goes through, and the last state of each key is returned


def _drain(stream: DataFrame, key: list[str], mode: str = "update", order: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream to its end and keep the last row written per key; ``order`` breaks ties in a batch."""
    spark = stream.sparkSession
    home = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{home}/out/batch={epoch}")

    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{home}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    rows = spark.read.parquet(f"{home}/out").drop("batch")
    return pool.latest(rows, key, ["_epoch", *order]).select(*stream.columns)


def _arriving(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files; a file source takes a single file as a pattern only."""
    return s.readStream.schema(i.table(s, d, name).schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


def _events(s: SparkSession, d: str) -> DataFrame:
    return _arriving(s, d, "events")


def stream_extract_state(s: SparkSession, d: str) -> DataFrame:
    return _state(_drain(jobs.extract_state(i.extract_events(_events(s, d)), docs=i.table(s, d, "documents")), ["doc_id"]))


def stream_graph_state(s: SparkSession, d: str) -> DataFrame:
    return _graph(_drain(jobs.graph_state(i.graph_events(_events(s, d))), ["graph_id"]))


def stream_new_files(s: SparkSession, d: str) -> DataFrame:
    pages = _arriving(s, d, "pages")
    files = pages.select(
        F.col("url").alias("path"), F.timestamp_seconds(F.col("page_id") + NOW).alias("modificationTime"),
        F.octet_length("html").cast("long").alias("length"), F.encode("html", "UTF-8").alias("content"),
    )
    home = f"{run_folder(s)}/stream-{uuid.uuid4().hex}"
    q = jobs.upsert_into(jobs.judged_files(files), f"{home}/out", f"{home}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return jobs.upserted(s, f"{home}/out").select("path", "name", "mime", "size")


def stream_stored_files(s: SparkSession, d: str) -> DataFrame:
    """The files of ``read_stored_files`` as they arrive: judged by their bytes and upserted by path."""
    files = jobs.judged_files(jobs.arriving_files(s, f"{i.stored_files(s, d)}/batch=*"))
    home = f"{run_folder(s)}/stream-{uuid.uuid4().hex}"
    jobs.upsert_into(files, f"{home}/out", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return jobs.upserted(s, f"{home}/out").select(_batch_of("path"), "size", "mime", "reason")


def stream_section_progress(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    ev = _events(s, d).select(
        F.col("user_id").alias("doc_id"), (F.get_json_object("props", "$.k").cast("int") % 20).alias("idx"), F.col("ts").cast("timestamp").alias("t"), "event_id",
        F.when(kind == "view", "start").when(kind == "signup", "outage").when(kind == "error", "error").otherwise("read").alias("kind"),
    )
    before = s.conf.get(jobs.ROCKSDB[0])
    s.conf.set(*jobs.ROCKSDB)
    try:
        return _drain(jobs.section_progress(ev), ["doc_id", "idx"], order=("step",)).drop("step")
    finally:
        s.conf.set(jobs.ROCKSDB[0], before)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_pool_documents__o1": load_pool_documents,
    "read_uploaded_files__o2": read_uploaded_files,
    "read_stored_files__o2": read_stored_files,
    "extract_view__o3": extract_view,
    "apply_changes__o4": apply_changes,
    "replace_by_owner__o5": replace_by_owner,
    "cascade_delete__o6": cascade_delete,
    "upload_kind__o7": upload_kind,
    "text_type__o8": text_type,
    "clean_name__o9": clean_name,
    "clip_bytes__o11": clip_bytes,
    "with_ending__o13": with_ending,
    "coherent__o17": coherent,
    "squeeze_blank_lines__o18": squeeze_blank_lines,
    "strip_bom__o19": strip_bom,
    "error_kind__o21": error_kind,
    "permitted__o22": permitted,
    "own_rows__o22": own_rows,
    "failure_reasons__o23": failure_reasons,
    "failure_sentences__o23": failure_sentences,
    "fold_events__o24": fold_events,
    "to_resume__o25": to_resume,
    "last_text__o24": last_text,
    "resume_kept__o24": resume_kept,
    "read_plan__o26": read_plan,
    "pack_pages__o27": pack_pages,
    "pack_long_files__o27": pack_long_files,
    "distinct_images__o29": distinct_images,
    "image_labels__o30": image_labels,
    "section_outcomes__o31": section_outcomes,
    "read_progress__o32": read_progress,
    "remaining_work__o33": remaining_work,
    "assemble_sections__o34": assemble_sections,
    "section_summary__o34": section_summary,
    "merge_tracks__o35": merge_tracks,
    "split_paragraphs__o36a": split_paragraphs,
    "query_terms__o36b": query_terms,
    "paragraph_scores__o36c": paragraph_scores,
    "indexed_scores__o36c": indexed_scores,
    "rank_paragraphs__o36d": rank_paragraphs,
    "select_paragraphs__o36e": select_paragraphs,
    "leading_text__o37": leading_text,
    "pack_pool__o38": pack_pool,
    "gap_rows__o39": gap_rows,
    "disclosure_notes__o40": disclosure_notes,
    "note_pieces__o40": note_pieces,
    "context_counts__o41": context_counts,
    "context_content__o38": context_content,
    "text_only__o42": text_only,
    "pack_with_refs__o43a": pack_with_refs,
    "uses_refs__o43a": uses_refs,
    "remember_refs__o43b": remember_refs,
    "invalidate_refs__o43c": invalidate_refs,
    "display_paths__o44": display_paths,
    "fold_graphs__o45": fold_graphs,
    "parse_answers__o46": parse_answers,
    "answer_elements__o46": answer_elements,
    "sanitise_nodes__o47a": sanitise_nodes,
    "sanitise_ports__o47b": sanitise_ports,
    "sanitise_edges__o47c": sanitise_edges,
    "edge_ids__o47d": edge_ids,
    "source_keys__o48b": source_keys,
    "stale_graphs__o48b": stale_graphs,
    "delete_nodes__o48c": delete_nodes,
    "distinct_cables__o48d": distinct_cables,
    "generation_outcomes__o48e": generation_outcomes,
    "sanitise_transcript__o49a": sanitise_transcript,
    "render_prompts__o49b": render_prompts,
    "latest_jobs__o50": latest_jobs,
    "judge_uploads__o51": judge_uploads,
    "batch_outcomes__o51": batch_outcomes,
    "newest_first__o52": newest_first,
    "read_sections__o53": read_sections,
    "read_files__o33": read_files,
    "answer_questions__o54": answer_questions,
    "ask_turns__o54": ask_turns,
    "ref_ledger__o43b": ref_ledger,
    "author_text__o55": author_text,
    "final_state__o56": final_state,
    "stream_extract_state__s1": stream_extract_state,
    "stream_graph_state__s2": stream_graph_state,
    "stream_section_progress__s3": stream_section_progress,
    "stream_new_files__s5": stream_new_files,
    "stream_stored_files__s5": stream_stored_files,
}
