"""Positions and running sums inside groups of any size.

A window over a group puts the whole group into one task. That is wrong when one key
holds a third of the rows, so rows are range-partitioned by key *and* order: a hot key
spans many partitions, and each partition's share is shifted by what lies before it.
The ordered rows are stored, so whoever reads them again does not sort again.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from poolwright.session import materialize

#: Rows that a shuffle deals to one task at most, unless they share a key.
ROWS_A_PART = 250_000


@contextlib.contextmanager
def enough_parts(spark: SparkSession, rows: int, each: int = ROWS_A_PART):
    """Within: shuffles of ``rows`` rows have at least a part for each ``each`` of them, whatever the session sets.

    What runs inside has to be stored there; the setting is put back. Small parts are still merged by the adaptive planner.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), -(-rows // each))))
    try:
        yield
    finally:
        spark.conf.set(name, before)



def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    position: str = "pos",
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group and inclusive running sums.

    ``order`` must tell the rows of a group apart, or name rows that are the same.
    """
    sums = sums or {}
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    # Written out once: the range bounds are drawn from a sample, and a second
    # evaluation could place rows differently.
    placed = materialize(
        df.withColumns({f"_v_{n}": c for n, c in sums.items()})
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", 33))

    part = [*keys, "_part"]
    shares = placed.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_row").alias("_first"),
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums],
    )
    # One row per key and partition: at most as many rows per key as there are partitions.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = shares.select(
        *part,
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    rows = Window.partitionBy(*part).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(rows) for n in sums})
    # The rows of a key lie side by side in a partition and are numbered there: only sums have to sort them again.
    at = F.col("_row") - F.col("_first") + 1
    return inside.join(shift, part).select(
        *df.columns,
        (at + F.col("_before")).alias(position),
        *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums],
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their 1-based position ``pos``.

    Spark limits each map task to ``most`` rows per key before the shuffle, so a
    hot key reaches its reducer already cut down. The rule applies up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default), and more is refused.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if most > limit:
        raise ValueError(f"{most} rows of each group: Spark cuts groups before a shuffle up to {limit} only")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most)


HOT = 1_000


def joined_by_share(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined to the ``groups`` they make by ``keys``, without a task that gets a large group whole.

    ``groups`` has one row per key, none of them null, and ``size``, how many rows its key has. Keys with more
    than one in ``hot`` of all rows cannot be more than ``hot``, whatever the input: they are broadcast, and
    their rows stay where they are. The others meet on the key. Both tables should be stored.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    large = F.col(size) * hot > total
    near = rows.join(F.broadcast(groups.filter(large)), keys)
    far = rows.join(F.broadcast(groups.filter(large).select(*keys)), keys, "left_anti").join(groups.filter(~large), keys)
    return near.unionByName(far)


def joined_in_order(value: Column, order: list[Column], sep: str) -> Column:
    """Aggregate: the values of a bounded group joined in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, value.alias("_value"))))
    return F.array_join(F.transform(rows, lambda r: r["_value"]), sep)
