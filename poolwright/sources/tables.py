"""Tables of a pool: fixed schemas, readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwright.operators.chat import replace_by_owner
from poolwright.session import materialize

DOCUMENTS = (
    "pool_id string, seq long, doc_id long, title string, kind string, mime string, "
    "description string, content string, size long, author string, created long"
)
EXTRACT_EVENTS = (
    "doc_id long, t timestamp, event_id long, state string, text string, source string, model string, "
    "engine string, error string, at long, text_layer boolean, done int, total int, label string, phase string"
)
GRAPH_EVENTS = (
    "graph_id string, t timestamp, event_id long, kind string, graph string, source_key string, "
    "note string, model string, engine string, at long"
)


def read_pool(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The documents of all pools. Missing values are empty, as the rest of the library expects."""
    docs = spark.read.schema(DOCUMENTS).format(form).load(path)
    text = ["title", "kind", "mime", "description", "content", "author"]
    return docs.fillna("", text).fillna(0, ["size", "created"])


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """Uploaded files: path, name, size, data. ``data`` is read only where it is selected."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select(
        "path",
        F.regexp_extract("path", "([^/]*)$", 1).alias("name"),
        F.col("length").alias("size"),
        F.col("content").alias("data"),
    )


def write_pool(docs: DataFrame, path: str) -> None:
    """Store documents by pool, so that a pool's reader touches its own folder only."""
    docs.write.mode("overwrite").partitionBy("pool_id").parquet(path)


OWNED_BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("owner"), F.lit(buckets)).cast("int").alias("_bucket")


def _write_buckets(rows: DataFrame, touched: DataFrame, path: str, buckets: int, mode: str) -> None:
    # A row of its own keeps each touched bucket from being empty: a dynamic overwrite passes over partitions without rows.
    marks = touched.select("_bucket").withColumn("_mark", F.lit(True))
    whole = rows.select("*", _bucket(buckets), F.lit(False).alias("_mark")).unionByName(marks, allowMissingColumns=True)
    whole.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def write_owned(rows: DataFrame, path: str, buckets: int = OWNED_BUCKETS) -> None:
    """Store rows that belong to owners (column ``owner``), in ``buckets`` folders by a hash of the owner."""
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_bucket"))
    _write_buckets(rows, every, path, buckets, "errorifexists")


def read_owned(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_owned`` and ``replace_owned`` have stored."""
    return spark.read.parquet(path).filter("not _mark").drop("_bucket", "_mark")


def replace_owned(spark: SparkSession, path: str, new: DataFrame, owners: DataFrame, buckets: int = OWNED_BUCKETS) -> None:
    """Replace all rows of ``owners`` by those of ``new``; an owner without new rows is cleared.

    Only the folders in which one of the owners lies are read and rewritten; the others keep their
    files. Another number of ``buckets`` than the table was written with would miss rows and is refused.
    The new folders are stored first, so nothing is read from what is being overwritten. One writer at a time.
    """
    stored = spark.read.parquet(path).select("_bucket")
    if stored.agg(F.count_distinct("_bucket")).first()[0] != buckets:
        raise ValueError(f"the table was not written with {buckets} buckets")
    touched = materialize(owners.select(_bucket(buckets)).distinct())
    names = [r["_bucket"] for r in touched.collect()]  # at most ``buckets``
    base = spark.read.parquet(path).filter(F.col("_bucket").isin(names) & ~F.col("_mark")).drop("_bucket", "_mark")
    _write_buckets(materialize(replace_by_owner(base, new, owners)), touched, path, buckets, "overwrite")
