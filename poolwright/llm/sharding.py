"""Sharding by proportional stratified interleaving.

The rows of each source are ranked in the order of a seeded digest. A row of rank r
among n has the place (r - u) / n, where u between 0 and 1 comes from its digest;
sorting all rows by place interleaves the sources in proportion, and equal cuts of
that order give shards whose sizes differ by at most one row and which all match the
mixture. With u sources of few rows lie anywhere, not all in the middle.

Both orders are laid out in buckets: the first by a digest, the second by place,
which is uniform for large and for small sources. Buckets hold about ``rows_each`` rows however
large a source is, counts of buckets give where each starts, and only a bucket is
sorted in one task. Only narrow rows move.

Defined cases: a null text has no bytes and the checksum 0; the null source is a
stratum of its own; rows equal in all columns the order uses are interchangeable;
extra columns ride along; an empty table gives an empty result; with fewer rows than
shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from poolwright.llm.common import packed, parts_for, table, unpacked
from poolwright.session import materialize

SHARDS = 40
SEED = "shard-1"
ROWS_EACH = 20_000


def _ranked(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """The 1-based place of each row among the rows of its keys, buckets in order; and _n, their number."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys, bucket, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return df.withColumn("_inside", inside).join(starts, [*keys, bucket]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", stratum: str = "source",
    seed: str = SEED, rows_each: int = ROWS_EACH, least_buckets: int = 256,
) -> DataFrame:
    """``docs`` (give it only the columns that should travel) with _shard and _slot."""
    total = docs.count()
    buckets = parts_for(total, rows_each, least_buckets)
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    rows = (
        packed(docs, _digest=digest, _stratum=F.coalesce(F.concat(F.lit("s"), F.col(stratum)), F.lit("n")))
        .withColumn("_tie", F.xxhash64("_in"))
        # leading bits of the digest, so that buckets follow its order
        .withColumn("_bucket", F.floor(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("double") * F.lit(buckets / 2.0**32)).cast("int"))
    )
    ranked = _ranked(rows, ["_stratum"], "_bucket", ["_digest", "_tie"], "_rank")
    # bits of the digest that had no part in the order of buckets
    inside = (F.conv(F.substring("_digest", 9, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0**32)
    placed = ranked.withColumn("_place", (F.col("_rank") - inside) / F.col("_n"))
    placed = materialize(
        placed.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor(F.col("_place") * buckets).cast("int"))).drop("_n", "_rank").withColumn("_all", F.lit(0))
    )
    ordered = _ranked(placed, ["_all"], "_bucket", ["_place", "_stratum", "_digest", "_tie"], "_at")
    at = F.col("_at") - 1
    shard = F.expr(f"cast((_at - 1) * {shards} div greatest(_n, 1) as int)")
    first = F.expr(f"((_at - 1) * {shards} div greatest(_n, 1) * _n + {shards} - 1) div {shards}")
    return unpacked(ordered, docs.columns, shard.alias("_shard"), (at - first).cast("long").alias("_slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write one folder per shard, each in slot order."""
    out = assign_shards(docs, **options)
    out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def op1(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )
