"""Fill a byte budget from a pool of documents, and say what was left out.

A pool is walked in storage order. What fits is taken whole, a file read with
text that does not fit is cut to the paragraphs that matter for the question, and
the rest is left out by name. The walk is sequential by nature; here it is split
into parts that are not:

* Everything before the first unit that does not fit is taken whole, whatever the
  question: a running sum per pool.
* Behind it, a unit whose smallest usable piece exceeds what is left can never be
  taken: a filter per pool.
* The remaining units are walked in rounds of a bounded number per pool. Each round
  spends part of the budget, so most units drop out of the next one by the filter.

Decisions that hold for every question of a pool carry no question id and are
written once, so the output does not grow as questions times documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.functions.text import byte_len, display_path, image_path, paragraphs, trim_space
from poolwright.operators.ordering import first_rows, joined_in_order, running
from poolwright.operators.retrieval import (
    SEPARATOR,
    leading_features,
    paragraph_features,
    pick,
    question_terms,
    ranked,
    take_greedily,
)
from poolwright.session import materialize

BUDGET = 24 << 20
ROUND_UNITS = 1000  # Spark cuts first_rows before the shuffle up to here
NOTE_PATH = "grounding-note"
NOTE_TYPE = "text/markdown"
IMAGE_TYPE = "image/jpeg"

# The sentences of the disclosure note, in order.
NOTE_OPENING = "The room knowledge below is INCOMPLETE for this answer. "
NOTE_CLOSING = "If a complete answer would depend on any of them, say clearly what you could not read."
NOTE_SENTENCES = {
    "omitted": "These documents were too large to include in full and were NOT provided to you: ",
    "omitted_image": "These document images were too large to include alongside the text and were NOT provided to you: ",
    "partial": "These documents are large, so only the parts most relevant to the question were included — other parts were left out: ",
    "not_read": "These uploaded files have not been read yet, so their text is NOT available to you: ",
    "unread": "These uploaded files could not be read, so their text is NOT available to you: ",
}
# Fixed value: the note when no engine sees pictures.
NO_VISION_NOTE = (
    "The room includes pictures (photographs, scans, nameplates) that could NOT be shown to the "
    "available AI engine, which cannot see images. Answer from the text below and say plainly that "
    "you could not see the room's images."
)


def base64_len(data: Column | str) -> Column:
    """Bytes of the base64 form, without encoding it."""
    n = F.octet_length(data) if isinstance(data, Column) else F.octet_length(F.col(data))
    return (F.ceil(n / 3) * 4).cast("long")


def context_units(
    docs: DataFrame, images: DataFrame | None = None, refs: DataFrame | None = None, delimiter: str = "\n\n"
) -> DataFrame:
    """What a pool can send, one row per unit, in sizes only.

    ``docs``: pool_id, seq, doc_id, title, kind, state, text, mime, where ``text`` is the
    content of a text document, the extract of a read file, or the bytes of a file never
    read (state empty; binary is welcome there as its own column ``data``).
    ``images``: doc_id, idx, page, data. ``refs``: doc_id, part, idx, ref.

    Output: pool_id, seq, sub, doc_id, part, idx, path, media_type, bytes, least, can_split,
    ref. ``least`` is the smallest number of bytes the unit can be cut to.
    """
    return with_refs(sized_units(docs, images, delimiter), refs)


def sized_units(docs: DataFrame, images: DataFrame | None = None, delimiter: str = "\n\n") -> DataFrame:
    """The units of ``context_units`` before references are known, empty ones too.

    Stored: every text is measured once, whoever reads its size and however often.
    """
    t = trim_space("text")
    kind, state = F.col("kind"), F.coalesce("state", F.lit(""))
    part = (
        F.when(kind == "text", "text")
        .when((kind == "file") & (state == "ready"), "extract")
        .when((kind == "file") & ~state.isin("pending", "reading", "failed"), "raw")
    )
    raw = byte_len("text")
    if "data" in docs.columns:  # a file that is no text counts by its bytes, however it is sent
        raw = F.coalesce(raw, F.octet_length("data").cast("long"))
    size = F.when(F.col("part") == "raw", F.coalesce(raw, F.lit(0))).otherwise(byte_len(t))
    smallest = F.array_min(F.transform(paragraphs("text", delimiter), byte_len))
    texts = (
        docs.withColumn("part", part)
        .filter(F.col("part").isNotNull())
        .select(
            "pool_id",
            F.col("seq").cast("long").alias("seq"),
            F.lit(0).alias("sub"),
            "doc_id",
            "title",
            F.when(F.col("part") == "raw", "raw").otherwise("text").alias("part"),
            F.lit(-1).alias("idx"),
            display_path("title").alias("path"),
            F.when(F.col("part") == "raw", F.col("mime")).otherwise(NOTE_TYPE).alias("media_type"),
            size.alias("bytes"),
            F.when(F.col("part") == "extract", smallest).otherwise(size).cast("long").alias("least"),
            (F.col("part") == "extract").alias("can_split"),
        )
    )
    texts = materialize(texts)
    if images is None:
        return texts.drop("title")
    # A file read to empty text is passed over, its pictures with it.
    owners = texts.filter(F.col("can_split") & (F.col("bytes") > 0)).select("pool_id", "seq", "doc_id", "title")
    shown = images.select("doc_id", "idx", "page", base64_len("data").alias("bytes"))
    pictures = shown.join(owners, "doc_id").select(
        "pool_id",
        "seq",
        (F.col("idx") + 1).cast("int").alias("sub"),
        "doc_id",
        F.lit("image").alias("part"),
        F.col("idx").cast("int").alias("idx"),
        image_path("title", "page").alias("path"),
        F.lit(IMAGE_TYPE).alias("media_type"),
        "bytes",
        F.col("bytes").alias("least"),
        F.lit(False).alias("can_split"),
    )
    return materialize(texts.drop("title").unionByName(pictures))


def with_refs(units: DataFrame, refs: DataFrame | None) -> DataFrame:
    """``sized_units`` with the references known for them, without those that are passed over."""
    if refs is None:
        units = units.withColumn("ref", F.lit(None).cast("string"))
    else:
        known = refs.filter(F.col("ref") != "").select(
            "doc_id",
            F.when(F.col("part") == "image", "image").otherwise("text").alias("_part"),
            F.col("idx").cast("int").alias("_idx"),
            "ref",
        )
        like = F.when(F.col("part") == "image", "image").otherwise("text")
        units = (
            units.withColumns({"_part": like, "_idx": F.col("idx")})
            .join(known, ["doc_id", "_part", "_idx"], "left")
            .drop("_part", "_idx")
        )
    # Empty content is passed over in silence; only a read file is passed over even with a reference.
    keep = (F.col("bytes") > 0) | (F.col("ref").isNotNull() & ~F.col("can_split"))
    return units.filter(keep)


def _left_out(part: Column) -> Column:
    return F.when(part == "image", "omitted_image").otherwise("omitted")


UNIT = ["pool_id", "seq", "sub", "doc_id", "part", "idx", "path", "media_type"]


def pack_pool(
    units: DataFrame,
    docs: DataFrame,
    questions: DataFrame | None = None,
    budget: int = BUDGET,
    delimiter: str = "\n\n",
    round_units: int = ROUND_UNITS,
) -> DataFrame:
    """Decide for every unit whether it is sent: whole, ref, partial, or left out by name.

    ``docs`` (pool_id, doc_id, text) supplies the paragraphs of the few files that may be
    cut; ``questions`` (question_id, pool_id, text) what they are cut for. Without questions
    a file is cut to its leading text.

    Output: question_id, the unit columns, decision, sent, chosen. A row without question_id
    holds for every question asked in that pool.
    """
    cost = F.when(F.col("ref").isNotNull(), F.lit(0)).otherwise(F.col("bytes")).cast("long")
    placed = materialize(
        running(
            units.withColumn("_cost", cost), ["pool_id"], ["seq", "sub"], "pos", {"upto": F.col("_cost")}
        ).drop("_cost")
    )
    fits = F.col("upto") <= budget
    edge = placed.groupBy("pool_id").agg(
        (F.lit(budget) - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("left0"),
        F.min(F.when(~fits, F.col("pos"))).alias("first"),
    )
    seen = placed.join(edge, "pool_id")
    behind = F.col("first").isNotNull() & (F.col("pos") >= F.col("first"))
    fate = (
        F.when(F.col("ref").isNotNull(), "ref")
        .when(~behind, "whole")
        .when(F.col("least") > F.col("left0"), _left_out(F.col("part")))
        .otherwise("open")
    )
    decided = seen.withColumn("decision", fate)
    settled = decided.filter(F.col("decision") != "open")
    unsure = decided.filter(F.col("decision") == "open").drop("decision")

    walked = _walk_rounds(unsure, docs, questions, delimiter, round_units)
    out = settled.select(
        F.lit(None).cast("long").alias("question_id"),
        *UNIT,
        "ref",
        "decision",
        F.when(F.col("decision") == "whole", F.col("bytes")).otherwise(F.lit(0)).cast("long").alias("sent"),
        F.array().cast("array<int>").alias("chosen"),
    )
    if walked is None:
        return out
    passed = unsure.join(walked.select("pool_id", "pos").distinct(), ["pool_id", "pos"], "left_anti")
    never = passed.select(
        F.lit(None).cast("long").alias("question_id"),
        *UNIT,
        "ref",
        _left_out(F.col("part")).alias("decision"),
        F.lit(0).cast("long").alias("sent"),
        F.array().cast("array<int>").alias("chosen"),
    )
    # What every question of a pool agrees on is stored once as well.
    verdict = F.struct("decision", "sent", "chosen")
    per_unit = walked.groupBy("pool_id", "pos").agg(F.min(verdict).alias("_lo"), F.max(verdict).alias("_hi"))
    agreed = per_unit.filter(F.col("_lo") == F.col("_hi")).select(
        F.lit(None).cast("long").alias("question_id"), "pool_id", "pos", "_lo.*"
    )
    apart = walked.join(agreed.select("pool_id", "pos"), ["pool_id", "pos"], "left_anti")
    chosen_here = (
        apart.select(*agreed.columns)
        .unionByName(agreed)
        .join(unsure.select("pool_id", "pos", *UNIT[1:], "ref"), ["pool_id", "pos"])
        .select("question_id", *UNIT, "ref", "decision", "sent", "chosen")
    )
    return out.unionByName(never).unionByName(chosen_here)


def _walk_rounds(
    unsure: DataFrame, docs: DataFrame, questions: DataFrame | None, delimiter: str, round_units: int
) -> DataFrame | None:
    """Walk the open units per question; (question_id, pool_id, pos, decision, sent, chosen).

    Every round takes the next ``round_units`` units of each pool that could still fit for some
    question; pools without such a unit are out. Their texts alone are split and matched, once, as
    a unit is in one round only: most units of a large pool fit for no question any more after the
    first. The rounds end when none is left; nothing is cut off.
    """
    texts = docs.select("pool_id", "doc_id", "text")
    if questions is None:
        asked = unsure.select("pool_id").distinct().select(
            F.lit(None).cast("long").alias("question_id"), "pool_id", F.array().cast("array<string>").alias("terms")
        )
    else:
        asked = question_terms(questions.select("question_id", "pool_id", "text"))
    starts = unsure.groupBy("pool_id").agg(F.first("left0").alias("left"))
    state = asked.join(starts, "pool_id").withColumn("upto", F.lit(0).cast("long"))
    rounds: list[DataFrame] = []
    while True:
        bound = state.groupBy("pool_id").agg(F.max("left").alias("_most"), F.max("upto").alias("_from"))
        ahead = unsure.join(bound, "pool_id").filter(
            (F.col("pos") > F.col("_from")) & (F.col("least") <= F.col("_most"))
        )
        batch = materialize(
            first_rows(
                ahead.select("pool_id", F.col("pos").alias("at"), "doc_id", "part", "bytes", "can_split"),
                ["pool_id"],
                ["at"],
                round_units,
            ).drop("pos")
        )
        if batch.isEmpty():
            break
        cut = texts.join(batch.filter("can_split").select("pool_id", "doc_id").distinct(), ["pool_id", "doc_id"], "left_semi")
        cut = cut.repartition("doc_id")  # neighbours in the pool are neighbours in its files too, and would be one task's
        feats = leading_features(cut, delimiter) if questions is None else paragraph_features(cut, questions, delimiter)
        step = materialize(_walk(batch, materialize(feats.withColumn("can_split", F.lit(True))), state))
        rounds.append(
            step.select("question_id", "pool_id", F.explode("log").alias("d")).select(
                "question_id", "pool_id", F.col("d.at").alias("pos"), "d.decision", "d.sent", "d.chosen"
            )
        )
        state = step.select("question_id", "pool_id", "terms", "left", "upto")
    if not rounds:
        return None
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def _walk(batch: DataFrame, feats: DataFrame, state: DataFrame) -> DataFrame:
    """One bounded walk per question over the units of its pool in this round."""
    units = batch.join(feats, ["pool_id", "doc_id", "can_split"], "left")
    per_question = (
        units.join(state, "pool_id")
        .withColumn("_rank", F.when(F.col("can_split"), ranked(F.col("paras"), F.col("terms"))))
        .groupBy("question_id", "pool_id")
        .agg(
            F.first("terms").alias("terms"),
            F.first("left").alias("left"),
            F.max("at").alias("upto"),
            F.sort_array(F.collect_list(F.struct("at", "part", "bytes", "can_split", "_rank"))).alias("todo"),
        )
    )
    entry = "array<struct<at:bigint,decision:string,sent:bigint,chosen:array<int>>>"
    start = F.struct(F.col("left").alias("left"), F.array().cast(entry).alias("log"))

    def visit(acc: Column, u: Column) -> Column:
        whole = u["bytes"] <= acc["left"]
        cut_to = take_greedily(u["_rank"], acc["left"])
        got = (
            F.when(whole, F.struct(u["bytes"].alias("used"), F.array().cast("array<int>").alias("chosen")))
            .when(u["can_split"], cut_to)
            .otherwise(F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("chosen")))
        )

        def record(_: Column, g: Column) -> Column:
            decision = (
                F.when(whole, "whole").when(g["used"] > 0, "partial").otherwise(_left_out(u["part"]))
            )
            line = F.struct(
                u["at"].alias("at"),
                decision.alias("decision"),
                g["used"].alias("sent"),
                F.sort_array(g["chosen"]).alias("chosen"),
            )
            return F.struct(
                (acc["left"] - g["used"]).alias("left"), F.array_append(acc["log"], line).alias("log")
            )

        # A one-element fold names the walk's result, so it is computed once.
        return F.aggregate(F.array(got), acc, record)

    done = per_question.withColumn("_end", F.aggregate("todo", start, visit))
    return done.select(
        "question_id", "pool_id", "terms", F.col("_end.left").alias("left"), "upto", F.col("_end.log").alias("log")
    )


def gap_rows(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """Everything not sent in full: question_id, pool_id, seq, sub, path, gap."""
    state = F.coalesce("state", F.lit(""))
    waiting = (
        docs.filter((F.col("kind") == "file") & state.isin("pending", "reading", "failed"))
        .select(
            F.lit(None).cast("long").alias("question_id"),
            "pool_id",
            F.col("seq").cast("long").alias("seq"),
            F.lit(0).alias("sub"),
            display_path("title").alias("path"),
            F.when(state == "failed", "unread").otherwise("not_read").alias("gap"),
        )
    )
    missing = packed.filter(F.col("decision").isin(*NOTE_SENTENCES)).select(
        "question_id", "pool_id", "seq", "sub", "path", F.col("decision").alias("gap")
    )
    return missing.unionByName(waiting)


def note_pieces(gaps: DataFrame, width: int = 1000) -> DataFrame:
    """The name lists of the disclosure note, in pieces of at most ``width`` storage positions.

    Output: question_id, pool_id, gap, piece, names. A piece without question_id serves every
    question of the pool, unless a row of the same (pool, piece) names the question. Reading
    the pieces in order and joining them with ", " gives the whole list of a gap.
    """
    placed = gaps.withColumn("piece", F.floor(F.col("seq") / width))
    shared = placed.filter(F.col("question_id").isNull()).drop("question_id")
    own = placed.filter(F.col("question_id").isNotNull())
    touched = own.select("question_id", "pool_id", "piece").distinct()
    merged = own.unionByName(shared.join(touched, ["pool_id", "piece"]).select(*own.columns))
    every = merged.unionByName(shared.withColumn("question_id", F.lit(None).cast("long")))
    return every.groupBy("question_id", "pool_id", "gap", "piece").agg(
        joined_in_order(F.col("path"), [F.col("seq"), F.col("sub")], ", ").alias("names")
    )


def _rank_of(gap: Column) -> Column:
    return F.coalesce(*[F.when(gap == g, F.lit(i)) for i, g in enumerate(NOTE_SENTENCES)])


def disclosure_notes(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The note in fragments: keys, gap, piece, fragment.

    Concatenated in the order of the gaps and their pieces the fragments are the whole note of
    a key, however many names it lists: no fragment grows with the pool.
    """
    gap, piece = F.col("gap"), F.col("piece")
    lists = pieces.groupBy(*keys, "gap").agg(F.min("piece").alias("_lo"), F.max("piece").alias("_hi"))
    gaps = pieces.groupBy(*keys).agg(F.min(_rank_of(gap)).alias("_first"), F.max(_rank_of(gap)).alias("_last"))
    lead = F.coalesce(*[F.when(gap == g, F.lit(t)) for g, t in NOTE_SENTENCES.items()])
    starts, ends = piece == F.col("_lo"), piece == F.col("_hi")
    blank = F.lit("")
    return (
        pieces.join(lists, [*keys, "gap"])
        .join(gaps, keys)
        .select(
            *keys,
            "gap",
            "piece",
            F.concat(
                F.when(starts & (_rank_of(gap) == F.col("_first")), NOTE_OPENING).otherwise(blank),
                F.when(starts, lead).otherwise(blank),
                "names",
                F.when(ends, ". ").otherwise(", "),
                F.when(ends & (_rank_of(gap) == F.col("_last")), NOTE_CLOSING).otherwise(blank),
            ).alias("fragment"),
        )
    )


def question_notes(pieces: DataFrame, questions: DataFrame) -> DataFrame:
    """One note per question that left something out: question_id, note.

    For the requests themselves: a request is one row, and its note is part of it.
    """
    asked = questions.select("question_id", "pool_id")
    own = pieces.filter(F.col("question_id").isNotNull())
    touched = own.select("question_id", "pool_id", "piece").distinct()
    shared = (
        pieces.filter(F.col("question_id").isNull())
        .drop("question_id")
        .join(asked, "pool_id")
        .join(touched, ["question_id", "pool_id", "piece"], "left_anti")
    )
    fragments = disclosure_notes(own.unionByName(shared), ["question_id"])
    return fragments.groupBy("question_id").agg(
        joined_in_order(F.col("fragment"), [_rank_of(F.col("gap")), F.col("piece")], "").alias("note")
    )


def with_notes(parts: DataFrame, notes: DataFrame) -> DataFrame:
    """Parts led by the note of their question: question_id, ord, path, media_type, content, ref, decision; key if given."""
    more = ["key"] if "key" in parts.columns else []
    head = notes.select(
        "question_id",
        F.lit(-1).cast("long").alias("ord"),
        F.lit(NOTE_PATH).alias("path"),
        F.lit(NOTE_TYPE).alias("media_type"),
        F.col("note").alias("content"),
        F.lit("").alias("ref"),
        F.lit("whole").alias("decision"),
        *[F.lit("").alias(c) for c in more],
    )
    return parts.select(*head.columns).unionByName(head)


SENT = ("whole", "ref", "partial")


def context_counts(packed: DataFrame, questions: DataFrame) -> DataFrame:
    """Document and image parts sent, per question. Shared decisions are counted once per pool."""
    image = F.col("media_type").startswith("image/")
    sent = packed.filter(F.col("decision").isin(*SENT))
    counts = [
        F.count_if(~image).alias("docs"),
        F.count_if(image).alias("images"),
        F.sum("sent").alias("bytes"),
    ]
    shared = sent.filter(F.col("question_id").isNull()).groupBy("pool_id").agg(*counts)
    own = sent.filter(F.col("question_id").isNotNull()).groupBy("question_id").agg(*counts)
    total = questions.select("question_id", "pool_id").join(shared, "pool_id", "left").join(
        own.toDF("question_id", "_docs", "_images", "_bytes"), "question_id", "left"
    )
    zero = F.lit(0)
    return total.select(
        "question_id",
        *[
            (F.coalesce(c, zero) + F.coalesce(f"_{c}", zero)).alias(c)
            for c in ("docs", "images", "bytes")
        ],
    )


def context_parts(packed: DataFrame, questions: DataFrame) -> DataFrame:
    """The parts each question is sent, without content: bounded by the budget per question, and stored."""
    sent = packed.filter(F.col("decision").isin(*SENT))
    shared = sent.filter(F.col("question_id").isNull()).drop("question_id").join(
        questions.select("question_id", "pool_id"), "pool_id"
    )
    return materialize(sent.filter(F.col("question_id").isNotNull()).unionByName(shared))


def with_content(
    parts: DataFrame, docs: DataFrame, images: DataFrame | None = None, delimiter: str = "\n\n"
) -> DataFrame:
    """Parts with what is sent as ``content``; joined last, and only for what is sent.

    A text whole is trimmed; a part of one is its chosen paragraphs joined by a blank line. A file
    never read is its text, or its bytes (column ``data``) as text or base64 by media type. A picture
    is base64. A reference has no content.
    """
    extra = ["data"] if "data" in docs.columns else []
    cut = F.array_join(pick(paragraphs("text", delimiter), F.col("chosen")), SEPARATOR)
    raw = F.coalesce("text", F.lit(""))
    if extra:
        raw = F.coalesce("text", _sent_bytes(), F.lit(""))
    content = (
        F.when(F.col("decision") == "ref", "")
        .when(F.col("decision") == "partial", cut)
        .when(F.col("part") == "raw", raw)
        .otherwise(trim_space("text"))
    )
    texts = parts.filter("part <> 'image'").join(docs.select("doc_id", "text", *extra), "doc_id")
    out = texts.withColumn("content", content).select(*parts.columns, "content")
    if images is None:
        return out
    pictures = parts.filter("part = 'image'").join(images.select("doc_id", F.col("idx").cast("int").alias("idx"), "data"), ["doc_id", "idx"])
    shown = F.when(F.col("decision") == "ref", "").otherwise(_base64("data"))
    return out.unionByName(pictures.withColumn("content", shown).select(*parts.columns, "content"))


def _base64(data: str) -> Column:
    return F.replace(F.base64(F.col(data)), F.lit("\r\n"), F.lit(""))


def _sent_bytes() -> Column:
    return F.when(F.col("media_type").startswith("text/"), F.make_valid_utf8(F.col("data").cast("string"))).otherwise(_base64("data"))


def text_only(parts: DataFrame, note: str = NO_VISION_NOTE) -> DataFrame:
    """Parts without their images, led by a note: question_id, ord, path, media_type, content; ref and decision if given.

    A text that was sent as a reference stays one.
    """
    columns = ["question_id", "ord", "path", "media_type", "content"]
    extra = {"ref": F.lit(""), "decision": F.lit("whole"), "key": F.lit("")}
    more = [c for c in extra if c in parts.columns]
    head = parts.select("question_id").distinct().select(
        "question_id",
        F.lit(-2).cast("long").alias("ord"),
        F.lit(NOTE_PATH).alias("path"),
        F.lit(NOTE_TYPE).alias("media_type"),
        F.lit(note).alias("content"),
        *[extra[c].alias(c) for c in more],
    )
    kept = parts.filter(~F.col("media_type").startswith("image/"))
    return kept.select(*columns, *more).unionByName(head)


def uses_refs(packed: DataFrame, questions: DataFrame) -> DataFrame:
    """Whether a question is sent any reference, so that a failure is worth a retry in full.

    Shared decisions are judged once per pool.
    """
    sent = packed.filter(F.col("decision").isin(*SENT))
    ref = F.bool_or(F.col("decision") == "ref").alias("ref")
    shared = sent.filter(F.col("question_id").isNull()).groupBy("pool_id").agg(ref)
    own = sent.filter(F.col("question_id").isNotNull()).groupBy("question_id").agg(ref.alias("_own"))
    no = F.lit(False)
    return (
        questions.select("question_id", "pool_id")
        .join(shared, "pool_id", "left")
        .join(own, "question_id", "left")
        .select("question_id", (F.coalesce("ref", no) | F.coalesce("_own", no)).alias("retry_due"))
    )


def unit_key() -> Column:
    """Names a unit among all: document, kind, and number of the picture. Titles may collide, keys cannot."""
    kind = F.when(F.col("part") == "image", "image").otherwise("text")
    return F.concat_ws(":", F.col("doc_id").cast("string"), kind, F.col("idx").cast("string"))


def remember_refs(parts: DataFrame, returned: DataFrame, keyed: bool = False) -> DataFrame:
    """File returned references under the unit they belong to: doc_id, part, idx, ref.

    ``parts``: question_id, ord, path, doc_id, part, idx, decision. ``returned``: question_id,
    ord, path, ref. Units are found by path; where titles collide the last one wins, and a
    partial send is never remembered. ``keyed``: units are found by the ``key`` that ``parts``
    and ``returned`` carry (``unit_key``) instead, so equal titles keep a reference each.
    """
    name = "key" if keyed else "path"
    full = parts.filter(F.col("decision").isin("whole", "ref"))
    origin = full.groupBy("question_id", name).agg(
        F.max_by(F.struct("doc_id", "part", "idx"), F.col("ord")).alias("unit")
    )
    found = returned.filter(F.col("ref") != "").join(origin, ["question_id", name])
    return (
        found.groupBy("unit.doc_id", "unit.part", "unit.idx")
        .agg(F.max_by("ref", F.struct("question_id", "ord")).alias("ref"))
    )


def invalidate_refs(refs: DataFrame, gone: DataFrame) -> DataFrame:
    """References without those of documents deleted or read again."""
    return refs.join(gone.select("doc_id"), "doc_id", "left_anti")
