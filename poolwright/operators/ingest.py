"""Uploads: judge every part of a batch, then the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwright.functions.files import clean_name, upload_kind
from poolwright.operators.ordering import first_rows

MOST_FILES, MOST_BYTES = 20, 100 << 20


def judge_uploads(parts: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Accept or refuse each part: batch, ord, name, mime, size, accepted, reason.

    ``parts``: batch, ord, name, data, size. Checked in order: place in the batch, emptiness,
    kind, size. The place needs only the ``most_files``-th part of each batch, which is found
    without bringing a batch together.
    """
    # What the bytes tell is read off in the scan; no file travels.
    name = clean_name("name")
    seen = parts.select(
        "batch",
        "ord",
        name.alias("name"),
        F.col("size").cast("long").alias("size"),
        (F.octet_length("data") == 0).alias("_empty"),
        upload_kind(name, "data").alias("_kind"),
    )
    slim = parts.select("batch", "ord")
    last = first_rows(slim, ["batch"], ["ord"], most_files).groupBy("batch").agg(F.max("ord").alias("_last"))
    judged = seen.join(last, "batch").withColumn("_over", F.col("ord") > F.col("_last"))
    # Why a part is refused.
    reason = (
        F.when(F.col("_over"), f"skipped — at most {most_files} files per upload")
        .when(F.col("_empty"), "the file is empty")
        .when(F.col("_kind.mime") == "", F.col("_kind.reason"))
        .when(F.col("size") > most_bytes, f"is over the {most_bytes >> 20} MB limit for one file")
        .otherwise("")
    )
    return judged.withColumn("reason", reason).select(
        "batch",
        "ord",
        "name",
        F.when(F.col("reason") == "", F.col("_kind.mime")).otherwise("").alias("mime"),
        "size",
        (F.col("reason") == "").alias("accepted"),
        "reason",
    )


def batch_outcomes(judged: DataFrame, batches: DataFrame) -> DataFrame:
    """Per batch: batch, accepted, rejected, outcome (ok, rejected, nothing), detail."""
    counts = judged.groupBy("batch").agg(
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.min_by(F.concat_ws(": ", "name", "reason"), F.when(~F.col("accepted"), F.col("ord"))).alias("first"),
    )
    zero = F.lit(0)
    ok, bad = F.coalesce("accepted", zero), F.coalesce("rejected", zero)
    return batches.select("batch").join(counts, "batch", "left").select(
        "batch",
        ok.alias("accepted"),
        bad.alias("rejected"),
        F.when(ok > 0, "ok").when(bad > 0, "rejected").otherwise("nothing").alias("outcome"),
        F.when(ok > 0, "").when(bad > 0, F.col("first")).otherwise("No files were uploaded").alias("detail"),
    )


def pending_documents(judged: DataFrame, author: str, created: int) -> DataFrame:
    """Accepted parts as documents waiting to be read. The id follows from batch and place."""
    return judged.filter("accepted").select(
        F.substring(F.sha2(F.concat_ws(":", "batch", "ord"), 256), 1, 16).alias("doc_id"),
        F.col("name").alias("title"),
        F.lit("file").alias("kind"),
        "mime",
        "size",
        F.lit(author).alias("author"),
        F.lit(created).cast("long").alias("created"),
        F.lit("pending").alias("state"),
    )
