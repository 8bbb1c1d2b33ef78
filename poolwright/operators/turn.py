"""A whole question turn: pack, note in front, ask, on failure drop references and ask in full, remember references.

References to content that a model already holds live in a ledger, a table by unit. A
turn reads the ledger of the turn before and leaves its own: what failed questions had been sent is
dropped, what answers returned is put in, all else stays. Each turn's ledger is a folder of its
own, so a turn that is run again overwrites only itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwright.operators import grounding, recognise
from poolwright.session import materialize

UNIT = ["doc_id", "part", "idx"]
LEDGER = "doc_id long, part string, idx int, ref string, turn int"
SUBS = 1 << 20  # places for the pictures of one document in the order of a request


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def ledger_at(spark: SparkSession, path: str, turn: int) -> DataFrame:
    """The ledger that turn number ``turn`` left; turn 0 left none."""
    return spark.read.schema(LEDGER).parquet(f"{path}/after={turn}") if turn else empty_ledger(spark)


def keep_ledger(ledger: DataFrame, path: str, turn: int) -> DataFrame:
    ledger.write.mode("overwrite").parquet(f"{path}/after={turn}")
    return ledger_at(ledger.sparkSession, path, turn)


def _grounded(docs, images, sized, ledger, questions, budget: int, delimiter: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is sent: the packing, its parts with their units, and the requests' parts with content and note."""
    units = grounding.with_refs(sized, ledger.select(*UNIT, "ref"))
    packed = materialize(grounding.pack_pool(units, docs, questions, budget, delimiter))
    parts = grounding.context_parts(packed, questions).withColumn("ord", F.col("seq") * SUBS + F.col("sub"))
    parts = parts.withColumns({"key": grounding.unit_key(), "ref": F.coalesce("ref", F.lit(""))})
    pieces = materialize(grounding.note_pieces(grounding.gap_rows(packed, docs)))
    notes = grounding.question_notes(pieces, questions)
    sent = grounding.with_notes(grounding.with_content(parts, docs, images, delimiter), notes)
    return packed, parts, sent


def _unit() -> list:
    kind = F.when(F.col("part") == "image", "image").otherwise("text").alias("part")
    return ["doc_id", kind, F.col("idx").cast("int").alias("idx")]


def ask_turn(
    docs: DataFrame, images: DataFrame | None, ledger: DataFrame, questions: DataFrame, model: Callable, turn: int,
    budget: int = grounding.BUDGET, delimiter: str = "\n\n", keyed: bool = False, sized: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers (as ``recognise.answer`` gives them) and the ledger after the turn.

    ``questions``: question_id, pool_id, text. All are packed against the ledger as it was before. Questions that fail although
    they were sent references are packed and asked once more, without the references of any unit they were sent; they
    alone are packed again. ``keyed``: the model returns references by key and not by path.
    ``sized``: the pool's ``grounding.sized_units``, where they were made already.
    """
    sized = grounding.sized_units(docs, images, delimiter) if sized is None else sized
    prompts = questions.select("question_id", F.col("text").alias("prompt"))
    packed, parts, sent = _grounded(docs, images, sized, ledger, questions, budget, delimiter)
    answers = materialize(recognise.answer(sent, prompts, model))
    due = grounding.uses_refs(packed, questions).filter("retry_due")
    failed = materialize(answers.filter("error <> ''").join(due, "question_id", "left_semi").select("question_id"))
    if not failed.isEmpty():
        stale = parts.join(failed, "question_id", "left_semi").select(*_unit()).distinct()
        ledger = materialize(ledger.join(stale, UNIT, "left_anti"))
        again = questions.join(failed, "question_id", "left_semi")
        _, parts_again, sent_again = _grounded(docs, images, sized, ledger, again, budget, delimiter)
        more = recognise.answer(sent_again, prompts.join(failed, "question_id", "left_semi"), model)
        answers = materialize(answers.join(failed, "question_id", "left_anti").unionByName(more))
        parts = parts.join(failed, "question_id", "left_anti").unionByName(parts_again)
    name = "key" if keyed else "path"
    returned = answers.filter("error = ''").select("question_id", F.explode("refs").alias(name, "ref")).withColumn("ord", F.lit(0))
    found = grounding.remember_refs(parts, returned, keyed).select(*_unit(), "ref", F.lit(turn).cast("int").alias("turn"))
    return answers, ledger.join(found, UNIT, "left_anti").select(*found.columns).unionByName(found)


def ask_turns(
    docs: DataFrame, images: DataFrame | None, turns: list[DataFrame], model: Callable, path: str, first: int = 1, **options
) -> tuple[DataFrame, DataFrame]:
    """Turns one after the other, each with the ledger of the one before: answers with their turn, and the last ledger.

    ``path`` holds the ledgers; ``first`` goes on from the turn before it. The pool is measured once for all turns.
    """
    spark, every = docs.sparkSession, []
    if "sized" not in options:
        options["sized"] = grounding.sized_units(docs, images, options.get("delimiter", "\n\n"))
    ledger = ledger_at(spark, path, first - 1)
    for turn, questions in enumerate(turns, first):
        answers, after = ask_turn(docs, images, ledger, questions, model, turn, **options)
        every.append(answers.withColumn("turn", F.lit(turn)))
        ledger = keep_ledger(after, path, turn)
    out = every[0]
    for answers in every[1:]:
        out = out.unionByName(answers)
    return out, ledger
