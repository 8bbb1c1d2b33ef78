"""The document pool as tables: views, changes, cascades, rights, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.functions.text import byte_len, trim_space

JOB_TTL = 600


def extract_view(docs: DataFrame, state: DataFrame, text: DataFrame) -> DataFrame:
    """What was read of each file: its document, its state and its text, files only.

    ``state``: doc_id and state fields. ``text``: doc_id, text.
    """
    files = docs.filter(F.col("kind") == "file").select("pool_id", "doc_id", "title")
    return files.join(state, "doc_id", "left").join(text.select("doc_id", "text"), "doc_id", "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. Combines before the shuffle, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def apply_changes(base: DataFrame, log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table after a log of upserts and deletes.

    ``log`` has the columns of ``base``, the order columns and ``op`` (upsert or delete). Only the
    last change of a key counts; deleting a missing key does nothing.
    """
    last = latest(log, [key], order)
    kept = base.join(last.select(key), key, "left_anti")
    return kept.select(*base.columns).unionByName(last.filter(F.col("op") == "upsert").select(*base.columns))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of deleted documents."""
    ids = gone.select(key).distinct()
    return {name: t.join(ids, key, "left_anti") for name, t in tables.items()}


def own_rows(rows: DataFrame, caller: Column | str) -> DataFrame:
    """The caller's own rows only."""
    return rows.filter(F.col("owner") == caller)


def permitted(rows: DataFrame, grants: DataFrame, group: str) -> DataFrame:
    """Rows of owners who are administrators or members of the group.

    ``grants``: owner, role, member_of.
    """
    allowed = grants.filter((F.col("role") == "admin") | (F.col("member_of") == group))
    return rows.join(allowed.select("owner"), "owner", "left_semi")


def latest_jobs(log: DataFrame, now: Column | int, ttl: int = JOB_TTL, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """The last state of each job; ended ones older than ``ttl`` seconds are dropped.

    ``log``: job_id, the order columns, state, done (epoch seconds, 0 while running), ….
    """
    last = latest(log, ["job_id"], list(order))
    ended = F.coalesce("done", F.lit(0))
    return last.filter((ended == 0) | (ended >= F.lit(now) - ttl))


def newest_first(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Newest first; ties by id, descending. With ``most``, only that many (a top-k)."""
    out = docs.orderBy(F.col("created").desc(), F.col("doc_id").desc())
    return out if most is None else out.limit(most)


def author_text(posts: DataFrame) -> DataFrame:
    """Turn posted texts into documents, or say why not.

    ``posts``: post_id, title, content, description, author, created.
    """
    title, content = trim_space("title"), trim_space("content")
    # Why a text is refused.
    reason = (
        F.when(title == "", "A title is required")
        .when(content == "", "The document must not be empty")
        .otherwise("")
    )
    return posts.select(
        "post_id",
        title.alias("title"),
        F.lit("text").alias("kind"),
        F.lit("text/markdown").alias("mime"),
        trim_space("description").alias("description"),
        content.alias("content"),
        byte_len(content).alias("size"),
        "author",
        "created",
        reason.alias("reason"),
    )
