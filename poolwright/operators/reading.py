"""A read from end to end: planned sections to results, state and text, in passes that go on where the last one stopped.

Results lie in a ledger by (document, total, section). A pass reads what has no final result
there: a section whose engine was out comes again, with the time-outs it has already
had, and one that was read never does. A plan with another number of sections starts anew. Every
pass writes a folder of its own, so a pass that is run again overwrites only itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwright.functions.files import with_ending
from poolwright.operators import extraction
from poolwright.operators.recognise import NO_RECOGNISER, TOO_LARGE, few_at_once
from poolwright.session import materialize

KEY = ["doc_id", "total", "idx"]
RESULTS = (
    "doc_id long, total long, idx int, outcome string, timeouts int, cause string, label string, track string, page int, "
    "text string, note string, too_big boolean, err string, model string, engine string, pass int"
)
_NAMES = [f.split()[0] for f in RESULTS.split(", ")]


def ledger(spark: SparkSession, path: str, passes: int) -> DataFrame:
    """What the first ``passes`` passes left: the last row of each section."""
    if not passes:
        return spark.createDataFrame([], RESULTS)
    rows = spark.read.schema(RESULTS).parquet(*[f"{path}/read={n}" for n in range(1, passes + 1)])
    rest = F.struct(*[c for c in _NAMES if c not in KEY])
    last = rows.groupBy(*KEY).agg(F.max_by(rest, "pass").alias("_r"))
    return last.select(*KEY, "_r.*").select(*_NAMES)


def read_pass(sections: DataFrame, plans: DataFrame, recogniser: Callable, path: str, number: int, most: int = 2) -> DataFrame:
    """Read what is left; returns the ledger after this pass, stored.

    ``sections``: doc_id, idx, title, label, mime, data, too_big, track, page, note. ``plans``: doc_id, total, has_text, has_ai.
    ``recogniser() -> read(name, mime, data, attempt) -> (text, engine, model)``; ``attempt`` counts from 0 and lets a second
    try take longer. A TimeoutError is an attempt that ran out of time, a ConnectionError an engine that is out,
    anything else a verdict on the section. Without an engine the sections of a document with a text of its own are
    named as unread; of other documents nothing is read.
    """
    spark = sections.sparkSession
    stored = materialize(ledger(spark, path, number - 1))
    final = stored.filter(~F.col("outcome").isin(*extraction.OPEN))
    planned = sections.join(plans.select("doc_id", F.col("total").cast("long").alias("total"), "has_ai", "has_text"), "doc_id")
    planned = planned.withColumn("idx", F.col("idx").cast("int"))
    again = stored.filter(F.col("outcome").isin(*extraction.OPEN)).select(*KEY, F.col("timeouts").alias("_timeouts"))
    todo = extraction.remaining_work(planned, final).join(again, KEY, "left")
    label, note = F.coalesce("label", F.lit("")), F.coalesce("note", F.lit(""))
    todo = todo.select(
        *KEY, label.alias("label"), F.coalesce("track", F.lit("")).alias("track"), F.coalesce("page", F.lit(0)).cast("int").alias("page"),
        note.alias("note"), F.coalesce("too_big", F.lit(False)).alias("too_big"), "has_ai", "has_text", "mime", "data",
        F.coalesce("_timeouts", F.lit(0)).alias("timeouts"),
        with_ending(F.when(label.isin("", "whole document", "image"), F.col("title")).otherwise(F.concat("title", F.lit(" ("), label, F.lit(")"))), "mime").alias("name"),
    )
    verdict = F.when(F.col("note") != "", "note").when(F.col("too_big"), "too_big").when(~F.col("has_ai") & F.col("has_text"), "error")
    empty = F.lit("")
    passed = todo.withColumn("outcome", verdict).filter("outcome is not null").select(
        *KEY, "outcome", "timeouts", empty.alias("cause"), "label", "track", "page", empty.alias("text"), "note",
        (F.col("outcome") == "too_big").alias("too_big"),
        F.when(F.col("outcome") == "too_big", TOO_LARGE).when(F.col("outcome") == "error", NO_RECOGNISER).otherwise("").alias("err"),
        empty.alias("model"), empty.alias("engine"), F.lit(number).alias("pass"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = recogniser()

        def one(name: str, mime: str, data: bytes, timeouts: int) -> tuple:
            while True:
                try:
                    text, engine, model = read(name, mime, bytes(data), timeouts)
                    return "read", timeouts, "", text, "", model, engine
                except TimeoutError:
                    timeouts += 1
                    if timeouts >= most:
                        return "too_slow", timeouts, "", "", extraction.TOO_SLOW, "", ""
                except ConnectionError:
                    return "interrupted", timeouts, "outage", "", "", "", ""
                except Exception as e:  # a verdict on the section, not a failed task
                    return "error", timeouts, "", "", str(e) or type(e).__name__, "", ""

        for b in batches:
            got = [one(*r) for r in zip(b["name"], b["mime"], b["data"], b["timeouts"], strict=True)]
            out = b[["doc_id", "total", "idx", "label", "track", "page", "note", "too_big"]].copy()
            for at, column in enumerate(("outcome", "timeouts", "cause", "text", "err", "model", "engine")):
                out[column] = [g[at] for g in got]
            out["pass"] = number
            yield out[_NAMES]

    asked = todo.withColumn("outcome", verdict).filter("outcome is null and has_ai").drop("has_ai", "has_text", "outcome")
    with few_at_once(spark):
        asked.mapInPandas(run, RESULTS).unionByName(passed).write.mode("overwrite").parquet(f"{path}/read={number}")
    return materialize(ledger(spark, path, number))


def verdicts(results: DataFrame, plans: DataFrame) -> DataFrame:
    """The state of every planned document (as ``extraction.final_state``) from a ledger; stored, so that what reads it plans no joins again."""
    of_plan = results.join(plans.select("doc_id", F.col("total").cast("long").alias("total")), ["doc_id", "total"], "left_semi")
    legible = (F.col("outcome") == "read") & (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return extraction.final_state(plans, of_plan.select("doc_id", "idx", "outcome", "cause", legible.alias("legible")))


def texts(results: DataFrame, plans: DataFrame, local: DataFrame, states: DataFrame, width: int = 1024) -> DataFrame:
    """The text of every document that is ready, in parts: the local text, then what has been read up to the first open section."""
    done = states.filter("state = 'ready'").select("doc_id", F.when(F.col("total") > 0, F.col("done")).alias("_upto"))
    of_plan = results.filter(~F.col("outcome").isin(*extraction.OPEN)).join(plans.select("doc_id", F.col("total").cast("long").alias("total")), ["doc_id", "total"], "left_semi")
    read = of_plan.join(done, "doc_id").filter(F.col("_upto").isNull() | (F.col("idx") < F.col("_upto")))
    read = materialize(read)
    parts = materialize(extraction.assemble_sections(read, width).join(extraction.section_summary(read), "doc_id"))
    return extraction.merge_tracks(local.join(done, "doc_id", "left_semi"), parts)
