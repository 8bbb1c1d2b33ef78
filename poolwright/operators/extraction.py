"""Reading files: document state, section planning, progress and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.functions.text import WHITE_SPACE, is_blank, trim_space
from poolwright.operators.ordering import enough_parts, first_rows, joined_in_order, running
from poolwright.session import materialize

STATES = ("pending", "reading", "ready", "failed")

# What a failed read or turn is reported as.
READ_FAILURES = {
    "no_ai": "The room assistant is not configured, so text in images and scans cannot be read yet. Retry once it is set up.",
    "too_large": "This part of the file is too large for the assistant to read even on its own, so it could not be read.",
    "unavailable": "No AI engine was available to read the file. Retry once an engine is connected.",
    "no_bytes": "the file's stored bytes could not be read",
}
READ_FAILURE = "The file's text could not be read. You can retry."
NO_TEXT = {
    "too_big": "This file is too large for the assistant to read in one request and could not be split into smaller parts, so its text could not be read.",
    "too_slow": "This file kept exceeding the read time limit even after the deadline was stretched, so its text could not be read.",
    "nothing": "No legible text could be read from this file. You can retry.",
}
INTERRUPTIONS = {"outage": "no AI engine was available", "timeout": "a section took too long"}
INTERRUPTION = "the read was cancelled"
ASK_FAILURES = {
    "disabled": "The room assistant is not configured on this server",
    "unavailable": "No AI engine is available — an admin can connect one",
}
ASK_FAILURE = "The assistant could not answer"
# Fixed value: the error of a section that ran out of attempts.
TOO_SLOW = "it kept exceeding the read time limit even after the deadline was stretched"


def _sentence(code: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def read_failure(code: Column) -> Column:
    return _sentence(code, READ_FAILURES, READ_FAILURE)


def ask_failure(code: Column) -> Column:
    return _sentence(code, ASK_FAILURES, ASK_FAILURE)


def interruption(done: Column, total: Column, code: Column) -> Column:
    # The pieces of the sentence.
    return F.concat(
        F.lit("The read was interrupted after section "),
        done.cast("string"),
        F.lit(" of "),
        total.cast("string"),
        F.lit(" ("),
        _sentence(code, INTERRUPTIONS, INTERRUPTION),
        F.lit("). Retry to continue from where it stopped."),
    )


def no_text_reason(results: DataFrame) -> DataFrame:
    """Why a document gave no text, from its section outcomes: doc_id, reason.

    Too big outranks too slow outranks nothing legible.
    """
    cause = F.when(F.bool_or(F.col("outcome") == "too_big"), "too_big").when(
        F.bool_or(F.col("outcome") == "too_slow"), "too_slow"
    )
    out = results.groupBy("doc_id").agg(F.coalesce(cause, F.lit("nothing")).alias("cause"))
    return out.select("doc_id", "cause", _sentence(F.col("cause"), NO_TEXT, NO_TEXT["nothing"]).alias("reason"))


def fold_events(events: DataFrame, docs: DataFrame | None = None, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Document state from its log of read events.

    Each field takes the value of the last event that touches it, so the whole fold is one
    aggregation that combines before the shuffle and also runs on a stream. Events of an
    unknown state touch nothing; with ``docs``, neither do those of an unknown document.
    """
    if docs is not None:
        events = events.join(docs.select("doc_id"), "doc_id", "left_semi")
    known = events.filter(F.col("state").isin(*STATES))
    return known.groupBy("doc_id").agg(*state_columns(order))


def state_columns(order: tuple[str, ...] = ("t",)) -> list[Column]:
    """The aggregates of ``fold_events``, for batch and stream alike."""
    at = F.struct(*order)
    state = F.col("state")
    pending, ready, failed = state == "pending", state == "ready", state == "failed"

    def last(value: Column, when: Column, name: str, empty: Column) -> Column:
        # max_by over the touching events only: the order is NULL for the others.
        return F.coalesce(F.max_by(value, F.when(when, at)), empty).alias(name)

    def reset(name: str, empty: Column) -> Column:
        return F.when(pending, empty).otherwise(F.coalesce(name, empty))

    no, none, zero = F.lit(False), F.lit(""), F.lit(0)
    anything = F.lit(True)
    counted = ~failed | (F.col("total") > 0)
    return [
        F.max_by("state", at).alias("state"),
        last(F.col("source"), ready, "source", none),
        last(F.col("model"), ready, "model", none),
        last(F.col("engine"), ready, "engine", none),
        last(F.when(failed, F.coalesce("error", none)).otherwise(none), ready | failed, "error", none),
        last(F.octet_length(F.coalesce("text", none)).cast("long"), ready, "size", zero.cast("long")),
        last(F.col("at"), ready | failed, "at", zero.cast("long")),
        last(reset("text_layer", no), anything, "text_layer", no),
        last(reset("done", zero), counted, "done", zero),
        last(reset("total", zero), counted, "total", zero),
        last(reset("label", none), counted, "label", none),
        last(F.when(pending | failed, none).otherwise(F.coalesce("phase", none)), anything, "phase", none),
    ]


def last_text(events: DataFrame, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """The text of the last ready event per document: doc_id, text. Kept apart from the state.

    The winner is found on its order alone and the text joined after, so that texts are
    not carried through the aggregation.
    """
    ready = events.filter(F.col("state") == "ready")
    latest = ready.groupBy("doc_id").agg(F.max(F.struct(*order)).alias("_last")).select("doc_id", "_last.*")
    return ready.join(latest, ["doc_id", *order], "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def to_resume(state: DataFrame) -> DataFrame:
    """Documents whose read must be taken up again. A failed one waits for a retry."""
    unfinished = (F.col("state") == "ready") & (F.col("total") > 0) & (F.col("done") < F.col("total"))
    return state.filter(F.col("state").isin("pending", "reading") | unfinished)


def resume_kept(state: DataFrame, resume: DataFrame) -> DataFrame:
    """Stored section results still needed: those of finished reads are dropped."""
    finished = state.filter((F.col("state") == "ready") & (F.col("done") >= F.col("total")))
    return resume.join(finished.select("doc_id"), "doc_id", "left_anti")


REQUEST_BYTES = 24 << 20


def read_plan(files: DataFrame, text_layer: DataFrame, images: DataFrame, pages: DataFrame | None = None, budget: int = REQUEST_BYTES) -> DataFrame:
    """How each file is read: doc_id, local_source, track, sections, too_big.

    ``files``: doc_id, mime, bytes. ``text_layer``: doc_id, coherent. ``images``: doc_id, idx. ``pages``: doc_id, page,
    bytes of the files that can be split. Track: ``none`` (text only), ``images``, ``pages`` (no text, no images), ``image``.
    A file of the track ``pages`` is one section within ``budget``; beyond it, as many as ``pack_pages`` makes of its
    pages, and one too big to send if it has none. A single picture cannot be split. ``too_big``: how many
    sections cannot be sent. Only files beyond the budget meet their pages.
    """
    counts = images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    mime = F.col("mime")
    text, pdf, image = mime.startswith("text/"), mime == "application/pdf", mime.startswith("image/")
    has_text = F.coalesce("coherent", F.lit(False))
    n = F.coalesce("n", F.lit(0))
    over = F.coalesce("bytes", F.lit(0)) > budget
    track = (
        F.when(text, "none").when(image, "image").when(pdf & (n > 0), "images")
        .when(pdf & has_text, "none").when(pdf, "pages").otherwise("unreadable")
    )
    found = (
        files.join(text_layer.select("doc_id", "coherent"), "doc_id", "left").join(counts, "doc_id", "left")
        .select("doc_id", F.when(text | (pdf & has_text), "text-layer").otherwise("").alias("local_source"), track.alias("track"), n.alias("n"), over.alias("_over"))
    )
    split = F.lit(None).cast("long")
    if pages is not None:
        found = materialize(found)
        large = found.filter((F.col("track") == "pages") & F.col("_over")).select("doc_id")
        packed = pack_pages(pages.join(large, "doc_id", "left_semi").select("doc_id", "page", "bytes"), budget)
        packed = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_split"), F.count_if("too_big").alias("_big"))
        found, split = found.join(packed, "doc_id", "left"), F.col("_split")
    track, one = F.col("track"), F.lit(1)
    beyond = (track == "pages") & F.col("_over")
    sections = F.when(track == "images", F.col("n")).when(beyond, F.coalesce(split, one)).when(track.isin("image", "pages"), one).otherwise(0)
    big = F.when(beyond & split.isNotNull(), F.col("_big") if pages is not None else one).when(beyond | ((track == "image") & F.col("_over")), one).otherwise(0)
    return found.select("doc_id", "local_source", "track", sections.cast("long").alias("sections"), big.cast("long").alias("too_big"))


PAGES_PER_SECTION = 12
BLOCK = 4096


def pack_pages(
    pages: DataFrame, budget: int, most: int = PAGES_PER_SECTION, block: int = BLOCK
) -> DataFrame:
    """Group consecutive pages into sections of at most ``budget`` bytes and ``most`` pages.

    ``pages``: doc_id, page (1, 2, 3, … without holes), bytes. A page over the budget is a
    section of its own. Output: doc_id, first_page, last_page, bytes, too_big, label.

    Where a section starts depends on all pages before it, so a document of any length is
    cut into blocks. What a block needs to know of the past is only how many of the last
    pages are still open, fewer than ``most``. Each block therefore states its exit for
    every possible entry; entries are then found by following these small tables, block by
    block inside groups of blocks and group by group above them.
    """
    if block < most:
        raise ValueError("a block must hold at least one whole section")
    budget_col = F.lit(budget).cast("long")
    at = F.floor((F.col("page") - 1) / block).cast("long")
    row = F.struct(F.col("page").cast("long").alias("page"), F.col("bytes").cast("long").alias("bytes"))
    near_end = (F.col("page") - 1) % block >= block - (most - 1)
    # The last pages of a block are also the past of the next one.
    spread = pages.select(
        "doc_id",
        row.alias("p"),
        F.explode(F.when(near_end, F.array(at, at + 1)).otherwise(F.array(at))).alias("block"),
    )
    blocks = spread.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list("p")).alias("all")).select(
        "doc_id",
        "block",
        F.filter("all", lambda p: p["page"] <= F.col("block") * block).alias("past"),
        F.filter("all", lambda p: p["page"] > F.col("block") * block).alias("own"),
    )
    lengths = pages.groupBy("doc_id").agg(F.max("page").cast("long").alias("n_pages"))
    blocks = blocks.join(lengths, "doc_id").filter(F.size("own") > 0)

    def open_bytes(n: Column) -> Column:
        tail = F.slice("past", F.greatest(F.size("past") - n + 1, F.lit(1)), n)
        total = F.aggregate(tail, F.lit(0).cast("long"), lambda s, p: s + p["bytes"])
        return F.when(n > 0, total).otherwise(F.lit(0).cast("long"))

    def advance(n: Column, size: Column, p: Column) -> tuple[Column, Column]:
        """Open pages and bytes behind page ``p``."""
        alone = p["bytes"] > budget_col
        joins = (n > 0) & (size + p["bytes"] <= budget_col)
        n2 = F.when(alone, 0).when(joins, n + 1).otherwise(1)
        full = n2 == most
        return F.when(full, 0).otherwise(n2), F.when(alone | full, F.lit(0).cast("long")).when(
            joins, size + p["bytes"]
        ).otherwise(p["bytes"])

    def exit_from(n: Column) -> Column:
        start = F.struct(n.cast("int").alias("n"), open_bytes(n).alias("size"))

        def step(a: Column, p: Column) -> Column:
            n2, size2 = advance(a["n"], a["size"], p)
            return F.struct(n2.cast("int").alias("n"), size2.alias("size"))

        return F.aggregate("own", start, step, lambda a: a["n"])

    only_one = F.col("n_pages") <= block
    long_docs = blocks.filter(~only_one)
    # Pages that do not fit together cannot be open together, so most entries of a block of large pages never occur.
    none_open = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("reach"))

    def one_more(a: Column, p: Column) -> Column:
        n, size = a["n"] + 1, a["size"] + p["bytes"]
        return F.struct(n.alias("n"), size.alias("size"), F.when(size > budget_col, a["reach"]).otherwise(n).alias("reach"))

    reach = F.aggregate(F.reverse("past"), none_open, one_more, lambda a: a["reach"])
    known = F.transform(F.sequence(F.lit(0), F.col("_reach")), exit_from)
    exits = long_docs.withColumn("_reach", reach).select(
        "doc_id", "block", F.concat(known, F.array_repeat(F.lit(0), F.lit(most - 1) - F.col("_reach"))).alias("exit")
    )
    entries = _block_entries(exits, most)
    entered = blocks.filter(only_one).withColumn("entry", F.lit(0)).unionByName(
        long_docs.join(entries, ["doc_id", "block"])
    )

    section = "array<struct<first_page:bigint,last_page:bigint,bytes:bigint>>"
    begin = F.struct(
        F.col("entry").cast("int").alias("n"),
        open_bytes(F.col("entry")).alias("size"),
        F.array().cast(section).alias("closed"),
    )

    def cut(a: Column, p: Column) -> Column:
        alone = p["bytes"] > budget_col
        joins = (a["n"] > 0) & (a["size"] + p["bytes"] <= budget_col)
        n2, size2 = advance(a["n"], a["size"], p)
        before = F.struct(
            (p["page"] - a["n"]).alias("first_page"),
            (p["page"] - 1).alias("last_page"),
            a["size"].alias("bytes"),
        )
        with_p = F.struct(
            F.when(joins, p["page"] - a["n"]).otherwise(p["page"]).alias("first_page"),
            p["page"].alias("last_page"),
            F.when(joins, a["size"] + p["bytes"]).otherwise(p["bytes"]).alias("bytes"),
        )
        none = F.array().cast(section)
        ends_before = F.when((a["n"] > 0) & ~joins, F.array(before)).otherwise(none)
        ends_here = F.when(alone | (n2 == 0), F.array(with_p)).otherwise(none)
        return F.struct(
            n2.cast("int").alias("n"),
            size2.alias("size"),
            F.concat(a["closed"], ends_before, ends_here).alias("closed"),
        )

    def finish(a: Column) -> Column:
        last = F.element_at("own", -1)["page"]
        open_end = (a["n"] > 0) & (last == F.col("n_pages"))
        rest = F.struct((last - a["n"] + 1).alias("first_page"), last.alias("last_page"), a["size"].alias("bytes"))
        return F.when(open_end, F.array_append(a["closed"], rest)).otherwise(a["closed"])

    sections = entered.select("doc_id", F.explode(F.aggregate("own", begin, cut, finish)).alias("s"))
    first, last = F.col("s.first_page"), F.col("s.last_page")
    return sections.select(
        "doc_id",
        first.alias("first_page"),
        last.alias("last_page"),
        F.col("s.bytes").alias("bytes"),
        (F.col("s.bytes") > budget_col).alias("too_big"),
        page_label(first, last).alias("label"),
    )


def _block_entries(exits: DataFrame, most: int, fan: int = 4096) -> DataFrame:
    """The entry of each block, from every block's table of exits: doc_id, block, entry.

    Two levels: ``fan`` blocks form a group, and a group's table is its blocks' tables
    followed in turn. No array holds more than ``fan`` blocks or one entry per group.
    """
    follow = lambda s, k: F.get(k["exit"], s)
    groups = (
        exits.withColumn("group", F.floor(F.col("block") / fan))
        .groupBy("doc_id", "group")
        .agg(F.sort_array(F.collect_list(F.struct("block", "exit"))).alias("kids"))
    )
    tables = groups.select(
        "doc_id",
        "group",
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda n: F.aggregate("kids", n, follow)).alias("exit"),
    )

    def trail(items: Column, first: Column) -> Column:
        """The state before each item, given the state before the first."""
        start = F.struct(first.cast("int").alias("s"), F.array().cast("array<int>").alias("seen"))
        step = lambda a, k: F.struct(
            F.get(k["exit"], a["s"]).alias("s"), F.array_append(a["seen"], a["s"]).alias("seen")
        )
        return F.aggregate(items, start, step, lambda a: a["seen"])

    tops = tables.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("group", "exit"))).alias("kids"))
    group_entry = tops.select(
        "doc_id", F.explode(F.arrays_zip(F.col("kids.group").alias("group"), trail(F.col("kids"), F.lit(0)).alias("entry"))).alias("e")
    ).select("doc_id", "e.group", F.col("e.entry").alias("_in"))
    return (
        groups.join(group_entry, ["doc_id", "group"])
        .select(
            "doc_id",
            F.explode(
                F.arrays_zip(F.col("kids.block").alias("block"), trail(F.col("kids"), F.col("_in")).alias("entry"))
            ).alias("e"),
        )
        .select("doc_id", "e.block", "e.entry")
    )


def page_label(first: Column, last: Column) -> Column:
    one = F.concat(F.lit("page "), first.cast("string"))
    many = F.concat(F.lit("pages "), first.cast("string"), F.lit("–"), last.cast("string"))
    return F.when(first == last, one).otherwise(many)


def distinct_images(refs: DataFrame) -> DataFrame:
    """Each picture once, at the first place it appears: doc_id, object, page, place."""
    return (
        refs.groupBy("doc_id", "object")
        .agg(F.min(F.struct("page", "place")).alias("p"))
        .select("doc_id", "object", "p.page", "p.place")
    )


def image_labels(images: DataFrame) -> DataFrame:
    """Add ``label``: the page, and the position on it where a page has several pictures."""
    placed = running(images, ["doc_id", "page"], ["place", "object"], "k")
    counts = images.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    page = F.concat(F.lit("on page "), F.col("page").cast("string"))
    which = F.concat(
        F.lit("image "), F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" ")
    )
    return placed.join(counts, ["doc_id", "page"]).withColumn(
        "label", F.concat(F.when(F.col("n") > 1, which).otherwise("image "), page)
    )


ABORTS = ("outage", "disabled", "cancelled")


def section_outcomes(attempts: DataFrame, order: list[str], most: int = 2) -> DataFrame:
    """What became of each section: doc_id, idx, outcome, attempts, cause.

    ``attempts``: doc_id, idx, outcome (``read``, ``error``, ``timeout``, ``outage``, ``disabled``,
    ``cancelled``, ``too_big``, ``note``). Of at most ``most`` attempts the first that did not time
    out decides; ``most`` time-outs make the section too slow; fewer leave it ``waiting``.
    An outage or a cancelled call is no attempt: the read goes on from there. Only if nothing came
    after it is the section ``interrupted``, with its cause.
    """
    tried = first_rows(attempts.filter(~F.col("outcome").isin(*ABORTS)), ["doc_id", "idx"], order, most)
    decisive = F.min_by("outcome", F.when(F.col("outcome") != "timeout", F.col("pos")))
    by = F.min(F.when(F.col("outcome") != "timeout", F.col("pos")))
    counted = tried.groupBy("doc_id", "idx").agg(
        decisive.alias("first"), by.alias("by"), F.count(F.lit(1)).alias("n")
    )
    last = attempts.groupBy("doc_id", "idx").agg(F.max_by("outcome", F.struct(*order)).alias("last"))
    aborted = F.col("last").isin(*ABORTS)
    decided = F.col("first").isNotNull() | (F.coalesce("n", F.lit(0)) >= most)
    return last.join(counted, ["doc_id", "idx"], "left").select(
        "doc_id",
        "idx",
        F.when(F.col("first").isNotNull(), F.col("first"))
        .when(decided, "too_slow")
        .when(aborted, "interrupted")
        .otherwise("waiting")
        .alias("outcome"),
        F.coalesce("by", "n", F.lit(0)).cast("long").alias("attempts"),
        F.when(~decided & aborted, F.col("last")).otherwise("").alias("cause"),
    )


OPEN = ("interrupted", "waiting")


def _reached(results: DataFrame, plans: DataFrame) -> DataFrame:
    """doc_id, at: the first section without a final result; what lies before it is done.

    The successor of a final section, or the first section, is where a read stands unless it
    is final itself: two joins on (document, section), so no document is gathered in one place.
    """
    final = results.filter(~F.col("outcome").isin(*OPEN)).select("doc_id", F.col("idx").cast("long").alias("idx"))
    next_ = final.select("doc_id", (F.col("idx") + 1).alias("idx")).unionByName(plans.select("doc_id", F.lit(0).cast("long").alias("idx")))
    return next_.join(final, ["doc_id", "idx"], "left_anti").groupBy("doc_id").agg(F.min("idx").alias("at"))


def read_progress(results: DataFrame, plans: DataFrame) -> DataFrame:
    """Where each read stands: doc_id, done, total, state, reason.

    ``results``: doc_id, idx (from 0), outcome, cause. ``plans``: doc_id, total, has_text. Sections
    are read in order: ``done`` counts those before the first without a final result. If that
    one is interrupted, text already there keeps the document usable, else the interruption is a
    named failure that can be resumed. A section that waits for its next attempt is not done.
    """
    at = _reached(results, plans)
    here = results.filter(F.col("outcome") == "interrupted").groupBy("doc_id", F.col("idx").cast("long").alias("at")).agg(F.max("cause").alias("cause"))
    out = plans.join(at, "doc_id", "left").join(here.withColumn("broken", F.lit(True)), ["doc_id", "at"], "left")
    total = F.col("total").cast("long")
    done = F.least(F.coalesce("at", F.lit(0)), total).cast("long")
    broken = F.coalesce("broken", F.lit(False)) & (done < total)
    return out.select(
        "doc_id",
        done.alias("done"),
        total.alias("total"),
        F.when(done >= total, "complete")
        .when(F.col("has_text"), "ready")
        .when(broken, "failed")
        .otherwise("reading")
        .alias("state"),
        F.when(broken & ~F.col("has_text"), interruption(done, total, F.col("cause"))).otherwise("").alias("reason"),
    )


def final_state(plans: DataFrame, results: DataFrame) -> DataFrame:
    """The verdict on reads that need none, cannot start, or have ended.

    ``plans``: doc_id, total, has_text, has_ai. ``results``: doc_id, idx, outcome, has_text of
    the section as ``legible``, and the cause of an interruption as ``cause`` if there is one; a
    planned section that is only a note counts as outcome ``note``, one too large as ``too_big``.
    Output: doc_id, state, reason, done, total, keep_images, keep_results. A read with sections
    left stands as ``read_progress`` has it. Pictures go only when a read has ended without any
    text; stored results go then, and when a read is complete or needs none.
    The states are stored: sorts and joins have parts enough for the number of results.
    """
    if "cause" not in results.columns:
        results = results.withColumn("cause", F.lit(""))
    per_doc = results.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or("legible").alias("legible"),
        F.bool_or(F.col("outcome") == "too_big").alias("any_big"),
        F.bool_or(F.col("outcome") == "too_slow").alias("any_slow"),
        F.bool_or(F.col("outcome") != "note").alias("needs_ai"),
    )
    stands = read_progress(results, plans).select(
        "doc_id", F.col("done").alias("at"), F.col("state").alias("stands"), F.col("reason").alias("why")
    )
    j = plans.join(per_doc, "doc_id", "left").join(stands, "doc_id", "left")
    total, text = F.col("total"), F.col("has_text")
    yes = lambda c: F.coalesce(c, F.lit(False))
    # a section without any row is still to be read, and needs an engine
    needs_ai = yes("needs_ai") | (F.coalesce("n", F.lit(0)) < total)
    case = (
        F.when((total == 0) & text, "local")
        .when(total == 0, "nothing")
        .when(~text & ~F.col("has_ai") & needs_ai, "no_ai")
        .when(~text & (total == 1) & yes("any_big"), "too_large")
        .when(F.col("at") < total, "reading")
        .when(~text & ~yes("legible"), F.when(yes("any_big"), "too_big").when(yes("any_slow"), "too_slow").otherwise("nothing_read"))
        .otherwise("done")
    )
    c = F.col("case")
    reason = (
        F.when(c.isin("no_ai", "too_large"), read_failure(c))
        .when(c.isin("nothing", "nothing_read", "too_big", "too_slow"), _sentence(c, NO_TEXT, NO_TEXT["nothing"]))
        .when(c == "reading", F.col("why"))
        .otherwise("")
    )
    ended_empty = c.isin("nothing_read", "too_big", "too_slow")
    out = j.withColumn("case", case).select(
        "doc_id",
        F.when(c.isin("local", "done"), "ready").when(c == "reading", F.col("stands")).otherwise("failed").alias("state"),
        reason.alias("reason"),
        F.when(c == "reading", F.col("at")).when(ended_empty, total).otherwise(0).cast("long").alias("done"),
        F.when((c == "reading") | ended_empty, total).otherwise(0).cast("long").alias("total"),
        (~ended_empty).alias("keep_images"),
        c.isin("nothing", "no_ai", "too_large", "reading").alias("keep_results"),
    )
    with enough_parts(results.sparkSession, results.count()):
        return materialize(out)


def remaining_work(sections: DataFrame, stored: DataFrame) -> DataFrame:
    """Sections with no stored result. Results of a plan with another total do not count.

    ``sections`` and ``stored``: doc_id, total, idx.
    """
    return sections.join(stored.select("doc_id", "total", "idx"), ["doc_id", "total", "idx"], "left_anti")


def section_name(label: Column) -> Column:
    t = trim_space(label)
    return F.when(t.isin("", "whole document", "image"), "this file").otherwise(t)


def section_piece() -> Column:
    """The text one section contributes; what could not be read is named in its place."""
    text, page = F.coalesce("text", F.lit("")), F.coalesce("page", F.lit(0))
    body = F.rtrim(text, F.lit("\n"))
    name = section_name(F.col("label"))
    # The heading of a picture and the sentences for gaps.
    headed = F.concat(F.lit("Image on page "), page.cast("string"), F.lit(":\n"), body)
    return (
        F.when(_given("note"), F.concat(F.lit("["), F.col("note"), F.lit("]")))
        .when(_flag("too_big"), F.concat(F.lit("["), name, F.lit(": too large to read in one request — this part was not read]")))
        .when(_given("err"), F.concat(F.lit("["), name, F.lit(": could not be read: "), F.col("err"), F.lit("]")))
        .when((F.col("track") == "image") & (page > 0), headed)
        .otherwise(body)
    )


def _given(name: str) -> Column:
    return F.coalesce(name, F.lit("")) != ""


def _flag(name: str) -> Column:
    return F.coalesce(name, F.lit(False))


def assemble_sections(results: DataFrame, width: int = 1024) -> DataFrame:
    """The text of each document from its sections: doc_id, part, text.

    ``results``: doc_id, idx, label, track, page, text, note, too_big, err, model, engine. A part
    holds at most ``width`` sections, so a document of any length stays in pieces; its whole
    text is the parts in order joined by a blank line. White space is trimmed at the ends of
    the whole, not of each part.
    """
    parts = (
        results.select("doc_id", "idx", section_piece().alias("piece"))
        .withColumn("part", F.floor(F.col("idx") / width))
        .groupBy("doc_id", "part")
        .agg(joined_in_order(F.col("piece"), [F.col("idx")], "\n\n").alias("text"))
    )
    filled = F.when(~is_blank("text"), F.col("part"))
    ends = parts.groupBy("doc_id").agg(F.min(filled).alias("lo"), F.max(filled).alias("hi"))
    first, last = F.col("part") == F.col("lo"), F.col("part") == F.col("hi")
    text = F.col("text")
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(WHITE_SPACE)))
    kept = F.when(first & last, trim_space(text)).when(first, F.substr(text, lead + 1)).when(
        last, F.rtrim(text, F.lit(WHITE_SPACE))
    ).otherwise(text)
    return parts.join(ends, "doc_id").filter(F.col("part").between(F.col("lo"), F.col("hi"))).select(
        "doc_id", "part", kept.alias("text")
    )


def section_summary(results: DataFrame) -> DataFrame:
    """Who read a document and whether anything legible came of it: doc_id, any_text, model, engine."""
    read = ~_given("note") & ~_flag("too_big") & ~_given("err")
    named = read & (_given("model") | _given("engine"))
    who = F.min_by(F.struct(F.coalesce("model", F.lit("")).alias("model"), F.coalesce("engine", F.lit("")).alias("engine")), F.when(named, F.col("idx")))
    return (
        results.groupBy("doc_id")
        .agg(F.bool_or(read & ~is_blank("text")).alias("any_text"), who.alias("who"))
        .select(
            "doc_id",
            "any_text",
            F.coalesce("who.model", F.lit("")).alias("model"),
            F.coalesce("who.engine", F.lit("")).alias("engine"),
        )
    )


def merge_tracks(local: DataFrame, read: DataFrame) -> DataFrame:
    """One text from the exact local text and what was read: doc_id, (part,) text, source, model, engine, any_text.

    ``local``: doc_id, text. ``read``: doc_id, text, any_text, model, engine, and part if the read
    text comes in parts. The local text stands before the lowest part, once; white space is
    trimmed at the two ends of the whole.
    """
    parted = "part" in read.columns
    r = read if parted else read.withColumn("part", F.lit(0))
    ends = r.groupBy("doc_id").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi"))
    r = r.join(ends, "doc_id")
    l = local.select("doc_id", F.col("text").alias("_local"))
    # The local text travels to the first part only; the others learn whether there is one.
    first = l.join(r.filter("part = _lo").withColumnRenamed("text", "_read"), "doc_id", "full")
    rest = r.filter("part > _lo").withColumnRenamed("text", "_read").join(
        l.select("doc_id", F.coalesce(F.col("_local") != "", F.lit(False)).alias("_has")), "doc_id", "left"
    )
    mine, theirs = F.coalesce("_local", F.lit("")), F.coalesce("_read", F.lit(""))
    whole = F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True))
    both = F.concat_ws("\n\n", F.rtrim(mine, F.lit("\n")), F.when(~is_blank(theirs) | ~whole, theirs))
    lead = F.ltrim(both, F.lit(WHITE_SPACE))
    text = F.when(mine == "", theirs).when(whole, trim_space(both)).otherwise(lead)
    columns = ["doc_id", "part", "text", "_has", "any_text", "model", "engine"]
    j = first.withColumn("part", F.coalesce("part", F.lit(0))).withColumn("text", text).withColumn("_has", mine != "").select(columns).unionByName(
        rest.withColumn("text", theirs).withColumn("_has", F.coalesce("_has", F.lit(False))).select(columns)
    )
    some, only_read, blank = F.coalesce("any_text", F.lit(False)), ~F.col("_has"), F.lit("")
    return j.select(
        "doc_id",
        *(["part"] if parted else []),
        "text",
        F.when(only_read, "ai").when(some, "mixed").otherwise("text-layer").alias("source"),
        F.when(only_read | some, F.coalesce("model", blank)).otherwise(blank).alias("model"),
        F.when(only_read | some, F.coalesce("engine", blank)).otherwise(blank).alias("engine"),
        (~only_read | some).alias("any_text"),
    )
