"""Mixing sources to target weights, in DataFrame functions only.

Words are summed by source, a target is derived for each source, and the rate of
a source is its target over its size. Every document is emitted floor(rate) times,
and once more if a number drawn from a hash of the seed and the document lies below
the fraction that is left. The draw depends on the row alone, so reruns agree.

Defined cases: a null or empty text has size 0 and is emitted like any other
document of its source; the null source is a source of its own and sorts last; a
source without any word has target and rate 0; equal rows draw the same number;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwright.llm.common import WORD, packed, table, unpacked
from poolwright.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, doc_id: str) -> Column:
    """A number in [0, 1) from the seed and the document: 52 bits of a digest."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to its target: by weight, at most ``most`` times its size, the excess reshared.

    Resharing until none is above has a closed form. In the order of bound over
    weight, the sources at their bound come first; what is left of the total goes
    to the others by weight. The first split that puts no other above its bound is
    the answer. ``sizes`` has one row per source, so the windows see only those.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    order = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(most))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(everyone) * F.lit(share))
        .withColumn("_caps_before", F.sum("_cap").over(upto) - F.col("_cap"))
        .withColumn("_w_left", F.sum("_w").over(everyone) - F.sum("_w").over(upto) + F.col("_w"))
        .withColumn("_level", (F.col("_total") - F.col("_caps_before")) / F.col("_w_left"))
    )
    # Taking a source out at its bound raises the level of the others while they are above theirs, and lowers it after.
    level = F.max("_level").over(everyone)
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.col("_ratio"))).over(everyone)
    return placed.withColumn(
        "target",
        F.when(first.isNull() | (F.col("_ratio") < first), F.col("_cap")).otherwise(F.col("_w") * level),
    ).select("source", "source_size", "target")


def rates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """One stored row per source: source, source_size, target, rate.

    Stored so that the planner knows its size when it picks the join with the documents.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(n_words(text)).alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return materialize(targets(sizes, weights, share, most).withColumn("rate", rate))


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str, weights, share: float, most: float, seed: str) -> DataFrame:
    """_in, _size, _source_size, _target, _copies for each document."""
    per = rates(docs, doc_id, text, source, weights, share, most)
    per = per.select(
        F.col("source").alias("_of"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.col("rate").alias("_rate"),
    )
    rows = packed(docs, _source=source, _size=n_words(text), _draw=draw(seed, doc_id))
    joined = rows.join(per, F.col("_source").eqNullSafe(F.col("_of")))
    whole = F.floor("_rate")
    extra = (F.col("_draw") < F.col("_rate") - whole).cast("long")
    return joined.select("_in", "_size", "_source_size", "_target", (whole + extra).cast("long").alias("_copies"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """The documents with the columns _size, _source_size, _target and _copies (how often each is taken)."""
    found = _mixed(docs, doc_id, text, source, weights, share, most, seed)
    return unpacked(found, docs.columns, "_size", "_source_size", "_target", "_copies")


def repeated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only."""
    found = _mixed(docs, doc_id, text, source, weights, share, most, seed).filter("_copies > 0")
    many = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return unpacked(many, docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source
), a AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio,
         sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), b AS (
  SELECT x.source, x.source_size, x.w, x.cap, x.ratio,
         (any_value(x.total) - coalesce(sum(y.cap) FILTER (WHERE y.ratio < x.ratio), 0))
           / sum(y.w) FILTER (WHERE y.ratio >= x.ratio) AS level
  FROM a x CROSS JOIN a y GROUP BY ALL
), t AS (
  SELECT source, source_size,
         CASE WHEN ratio < (SELECT coalesce(min(ratio), 1e308) FROM b WHERE level <= ratio) THEN cap
              ELSE w * (SELECT max(level) FROM b) END AS target FROM b
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN ('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE
                                               / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""
