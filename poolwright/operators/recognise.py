"""The two places where Python runs: reading sections and asking a model.

Both take a callable the caller supplies. It is created once per task by a factory, so it
may hold a client, and its errors become a column and never fail a task.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwright.functions.files import with_ending
from poolwright.functions.text import trim_space
from poolwright.operators.grounding import text_only
from poolwright.session import materialize

RESULT = (
    "doc_id long, idx int, label string, track string, page int, text string, note string, "
    "too_big boolean, err string, model string, engine string"
)
TOO_LARGE = "too large to read in one request"
NO_RECOGNISER = "no recogniser is configured"


#: Bytes of requests or sections that go to a Python worker at once (one row may exceed it).
AT_ONCE = 32 << 20


@contextlib.contextmanager
def few_at_once(spark: SparkSession, most: int = AT_ONCE):
    """Within: Arrow batches of about ``most`` bytes at most. What runs inside has to be stored there; the setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_sections(sections: DataFrame, recogniser: Callable | None, result: str = RESULT) -> DataFrame:
    """Read each section with ``recogniser() -> read(name, mime, data) -> (text, engine, model)``.

    ``sections``: doc_id, idx, title, label, mime, data, too_big, track, page, note. A note and an
    over-large section are passed through unread. Without a recogniser every other section
    says so in ``err``. Only sections that are read cross over to Python. What was read is stored:
    it is asked for once, however often the result is used.
    """
    label = F.coalesce("label", F.lit(""))
    plain = label.isin("", "whole document", "image")
    name = F.when(plain, F.col("title")).otherwise(F.concat("title", F.lit(" ("), label, F.lit(")")))
    noted = F.coalesce("note", F.lit("")) != ""
    big = F.coalesce("too_big", F.lit(False))
    unread = noted | big | F.lit(recogniser is None)
    err = F.when(noted, "").when(big, TOO_LARGE).otherwise(NO_RECOGNISER)
    fields = [f.split()[0] for f in result.split(", ")]
    passed = sections.filter(unread).select(
        "doc_id", F.col("idx").cast("int").alias("idx"), label.alias("label"), F.coalesce("track", F.lit("")).alias("track"),
        F.coalesce("page", F.lit(0)).cast("int").alias("page"), F.lit("").alias("text"),
        F.coalesce("note", F.lit("")).alias("note"), (big & ~noted).alias("too_big"), err.alias("err"),
        F.lit("").alias("model"), F.lit("").alias("engine"),
    )
    if recogniser is None:
        return passed
    todo = sections.filter(~unread).select(
        "doc_id", F.col("idx").cast("int").alias("idx"), label.alias("label"), F.coalesce("track", F.lit("")).alias("track"),
        F.coalesce("page", F.lit(0)).cast("int").alias("page"), with_ending(name, "mime").alias("name"), "mime", "data",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = recogniser()

        def one(name, mime, data):
            try:
                text, engine, model = read(name, mime, bytes(data))
                return text, engine, model, ""
            except Exception as e:  # an unreadable section is a result, not a failed task
                return "", "", "", str(e) or type(e).__name__

        for b in batches:
            got = [one(*r) for r in zip(b["name"], b["mime"], b["data"])]
            out = b[["doc_id", "idx", "label", "track", "page"]].copy()
            out["text"], out["engine"], out["model"], out["err"] = zip(*got) if got else ([], [], [], [])
            out["note"], out["too_big"] = "", False
            yield out[fields]

    with few_at_once(sections.sparkSession):
        read = materialize(todo.mapInPandas(run, result))
    return read.unionByName(passed)


ANSWER = "question_id long, output string, model string, engine string, error string, refs map<string,string>"


def answer(parts: DataFrame, prompts: DataFrame, model: Callable) -> DataFrame:
    """Ask ``model() -> ask(prompt, parts) -> (output, model, engine, {path: ref})`` per question.

    ``parts``: question_id, ord, path, media_type, content, ref, decision, and key where references
    are kept by key; ``prompts``: question_id, prompt. One request is one row, bounded by the context budget,
    and a few requests go to Python at once. Questions that no engine can see the images of are asked again without.
    """
    first = _ask(parts, prompts, model)  # stored: a question is asked once, whoever reads the answer
    blind = first.filter(F.col("error") == "no vision engine").select("question_id")
    again = _ask(
        text_only(parts.join(blind, "question_id", "left_semi")), prompts.join(blind, "question_id", "left_semi"), model
    )
    return first.filter(F.col("error") != "no vision engine").unionByName(again)


def retry_in_full(answers: DataFrame, due: DataFrame, full_parts: DataFrame, prompts: DataFrame, model: Callable) -> DataFrame:
    """Ask failed questions that were sent references once more, with ``full_parts`` instead.

    ``due``: question_id, retry_due, as ``uses_refs`` gives it.
    """
    sent_refs = due.filter("retry_due").select("question_id")
    failed = answers.filter(F.col("error") != "").join(sent_refs, "question_id", "left_semi").select("question_id")
    again = answer(
        full_parts.join(failed, "question_id", "left_semi"), prompts.join(failed, "question_id", "left_semi"), model
    )
    return answers.join(failed, "question_id", "left_anti").unionByName(again)


def _ask(parts: DataFrame, prompts: DataFrame, model: Callable) -> DataFrame:
    key = ["key"] if "key" in parts.columns else []
    sent = F.sort_array(F.collect_list(F.struct("ord", "path", "media_type", "content", "ref", *key)))
    requests = prompts.select("question_id", trim_space("prompt").alias("prompt")).join(
        parts.groupBy("question_id").agg(sent.alias("parts")), "question_id", "left"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()

        def one(prompt, rows):
            try:
                output, name, engine, refs = ask(prompt, [dict(r) for r in rows] if rows is not None else [])
                return output, name, engine, "", refs
            except Exception as e:  # a failed turn is a result
                return "", "", "", str(e) or type(e).__name__, {}

        for b in batches:
            got = [one(p, r) for p, r in zip(b["prompt"], b["parts"])]
            out = b[["question_id"]].copy()
            for i, c in enumerate(["output", "model", "engine", "error", "refs"]):
                out[c] = [g[i] for g in got]
            yield out

    with few_at_once(parts.sparkSession):
        return materialize(requests.mapInPandas(run, ANSWER))
