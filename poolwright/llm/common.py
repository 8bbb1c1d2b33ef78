"""Small helpers that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from poolwright.session import materialize

#: White space of the text rules: the space and the characters 09 to 0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str, text: str) -> Column:
    """Tells rows apart that carry one doc_id but different texts; rows equal in both share a key."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.xxhash64(text).cast("string"))


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send at most ``rows`` rows to Python at once: texts are long, and the default of 10,000 would need tens of megabytes a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def plain_reads(spark: SparkSession) -> None:
    """Read Parquet files piece by piece: with vectored reads every thread of the file system's own pool
    keeps a direct buffer as large as the largest column chunk that it has read, beside the heap and never freed."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def give_back() -> None:
    """At the end of a task: return freed Arrow memory, which idle workers would keep."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def parts_for(rows: int, each: int, least: int = 1) -> int:
    """How many parts ``rows`` rows make at ``each`` rows a part."""
    return max(least, -(-rows // each))


def packed(docs: DataFrame, **named: Column | str) -> DataFrame:
    """All columns of ``docs`` as one column _in, besides the ``named`` ones: no name can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("_in"), *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in named.items()])


def unpacked(found: DataFrame, columns: list[str], *more: Column | str) -> DataFrame:
    """The columns that ``packed`` took in, then ``more``; where both have a name, that of ``more`` counts."""
    extra = [F.col(c) if isinstance(c, str) else c for c in more]
    taken = set(found.select(*extra).columns)
    return found.select(*[F.col("_in").getField(c).alias(c) for c in columns if c not in taken], *extra)


FOLDS = 5


def held_out(doc_id: str) -> Column:
    """True for the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sampled(labels: DataFrame, label: str, rows: int) -> tuple[DataFrame, float]:
    """Labels to learn from: stored (_of, _label), about ``rows`` at most, and how much the sample shifts log-odds.

    Of several labels of one doc_id the largest counts. Each label has half of the rows, and what
    the other leaves; the id that is drawn first is always taken, so a label that occurs is learned
    from however rare it is. A model of the sample subtracts the shift from its log-odds.
    """
    draw = F.xxhash64(F.col("_of"), F.lit(17)).bitwiseAND(F.lit((1 << 62) - 1))
    usable = labels.select(F.col("doc_id").alias("_of"), F.col(label).cast("int").alias("_label"))
    usable = usable.filter(F.col("_label").isNotNull() & F.col("_of").isNotNull() & ~held_out("_of"))
    usable = usable.groupBy("_of").agg(F.max("_label").alias("_label")).withColumn("_draw", draw)
    found = {r["_label"]: r for r in usable.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.min("_draw").alias("least")).collect()}
    count = {k: found[k]["n"] if k in found else 0 for k in (0, 1)}
    share = {k: min(1.0, max(rows // 2, rows - count[1 - k]) / max(1, count[k])) for k in (0, 1)}
    taken = F.lit(False)
    for k in found.keys() & share.keys():
        drawn = (F.col("_draw") < int(share[k] * (1 << 62))) | (F.col("_draw") == found[k]["least"]) | F.lit(share[k] >= 1)
        taken = taken | ((F.col("_label") == k) & drawn)
    shift = math.log(share[1] / share[0]) if all(count.values()) else 0.0
    return materialize(usable.filter(taken).select(F.col("_of").cast("long").alias("_of"), "_label")), shift


BITS = 1 << 24


def may_hold(df: DataFrame, key: str, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """``df`` with the column _may: false where the string ``key`` is surely not among ``keys``.

    A bit map of fixed size (``bits`` / 8 bytes, 2 MiB by default, whatever the input) is built by
    an aggregate and broadcast. It only spares rows a shuffle; an exact join has to follow for the rest.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = materialize(
        keys.select(slot.alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    )
    columns = [F.col(f"`{c}`") for c in df.columns]
    found = df.withColumn("_slot", slot).withColumn("_b", F.bitmap_bucket_number("_slot")).withColumn("_p", F.bitmap_bit_position("_slot"))
    found = found.join(F.broadcast(maps), F.col("_b") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.expr("shiftright(_byte, cast(_p % 8 as int)) & 1 = 1")
    return found.withColumn("_byte", byte).withColumn("_may", F.coalesce(may, F.lit(False))).select(*columns, "_may")


def without(docs: DataFrame, doc_id: str, text: str, stay: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; only rows that may go are shuffled.

    ``gone``: the keys (_row) of which a row goes. ``stay``: (_row, _times), how many of the
    rows with that key stay, for all keys. Rows that share a key are equal in id and text.
    """
    marked = may_hold(packed(docs, _row=row_key(doc_id, text)), "_row", gone.select("_row"))
    asked = marked.filter("_may").withColumnRenamed("_row", "_key")
    left = asked.join(stay.hint("merge"), F.col("_key") == F.col("_row"))
    order = Window.partitionBy("_row").orderBy(F.xxhash64("_in"))
    left = left.withColumn("_n", F.row_number().over(order)).filter("_n <= _times")
    return unpacked(marked.filter("not _may").select("_in").unionByName(left.select("_in")), docs.columns)
