"""Conversations: sanitise, replace per owner, render as a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.functions.text import clip, cut_bytes, trim_space
from poolwright.operators.ordering import first_rows, joined_in_order

MOST_MESSAGES, TEXT_BYTES, LABEL_BYTES = 200, 100_000, 100
ROLES = ("user", "assistant")


def sanitise_transcript(
    messages: DataFrame, now: Column | int, most: int = MOST_MESSAGES, text_bytes: int = TEXT_BYTES
) -> DataFrame:
    """``messages``: owner, turn, role, text, model, engine, created.

    The newest ``most`` turns are kept before any is dropped for its role or for being empty.
    """
    newest = first_rows(messages, ["owner"], [F.col("turn").desc()], most)
    text = trim_space("text")
    now = F.lit(now) if isinstance(now, int) else now
    return newest.filter(F.col("role").isin(*ROLES) & (text != "")).select(
        "owner",
        "turn",
        "role",
        cut_bytes(text, text_bytes).alias("text"),
        clip("model", LABEL_BYTES).alias("model"),
        clip("engine", LABEL_BYTES).alias("engine"),
        F.coalesce(F.nullif("created", F.lit(0)), now).cast("long").alias("created"),
    )


def replace_by_owner(base: DataFrame, new: DataFrame, owners: DataFrame) -> DataFrame:
    """The stored messages with those of ``owners`` replaced by ``new``.

    An owner without new messages is cleared.
    """
    kept = base.join(owners.select("owner").distinct(), "owner", "left_anti")
    return kept.select(*base.columns).unionByName(new.join(owners.select("owner").distinct(), "owner", "left_semi"))


def render_prompts(messages: DataFrame, preamble: str, no_docs_note: str = "", pool_docs: DataFrame | None = None) -> DataFrame:
    """One prompt per owner from a sanitised transcript: owner, prompt.

    ``pool_docs`` (owner, n) says how many documents the owner's pool holds; at none, the
    note tells the model so.
    """
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("text"))
    talks = messages.groupBy("owner").agg(joined_in_order(line, [F.col("turn")], "\n\n").alias("talk"))
    if pool_docs is None:
        empty = F.lit(no_docs_note != "")
    else:
        talks = talks.join(pool_docs.select("owner", "n"), "owner", "left")
        empty = F.coalesce("n", F.lit(0)) == 0
    note = F.when(empty, F.lit(no_docs_note + "\n\n")).otherwise("")
    return talks.select(
        "owner",
        F.concat(F.lit(preamble + "\n\n"), note, F.col("talk"), F.lit("\n\nAssistant:")).alias("prompt"),
    )
