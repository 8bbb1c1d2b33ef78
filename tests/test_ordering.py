"""Positions and sums of groups too large for one task."""

import random

import pytest
from pyspark.sql import Window, functions as F

from poolwright.operators.ordering import HOT, first_rows, joined_by_share, running
from poolwright.session import scratch_folder


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_places_equal_a_window(spark, parts):
    """One key holds most rows; places and sums are those of a window."""
    rng = random.Random(8)
    rows = [(("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 30)}"), rng.randint(0, 10**6), n, rng.randint(0, 9)) for n in range(4000)]
    df = spark.createDataFrame(rows, "k string, a long, b long, v long").repartition(parts)
    w = Window.partitionBy("k").orderBy("a", F.col("b").desc())
    want = df.select("*", F.row_number().over(w).cast("long"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = running(df, ["k"], ["a", F.col("b").desc()], "pos", {"upto": F.col("v")})
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_hot_key_is_split(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), "id")
    out = running(df, ["k"], ["id"])
    assert "_part" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter("pos <> id + 1").count() == 0


def test_first_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = first_rows(df, ["k"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rows_learn_of_large_and_small_groups(spark):
    """A third of the rows has one key, most keys have one row; no key of the shuffled side has a large share."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = joined_by_share(rows, groups, ["k"], "n")
    want = rows.join(groups, "k").select("k", "id", "n", "first")
    assert sorted(out.select("k", "id", "n", "first").collect()) == sorted(want.collect())
    assert groups.filter(F.col("n") * HOT > 6000).count() == 1
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert joined_by_share(rows.limit(0), groups.limit(0), ["k"], "n").count() == 0


def test_scratch_folder_follows_the_session(spark):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: "/shared" if name == "spark.checkpoint.dir" else default)

    assert scratch_folder(Session) == "/shared"
    assert scratch_folder(spark) == scratch_folder(spark)


def test_places_take_no_second_sort(spark):
    df = spark.createDataFrame([(k % 3, k, "x") for k in range(50)], "g long, o long, v string")
    out = running(df, ["g"], ["o"])
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.g, r.o): r.pos for r in out.collect()} == {(k % 3, k): k // 3 + 1 for k in range(50)}


def test_entries_that_cannot_occur_are_not_followed(spark, monkeypatch):
    from poolwright.operators import extraction

    seen, follow = [], extraction._block_entries
    monkeypatch.setattr(extraction, "_block_entries", lambda exits, most: seen.extend(exits.collect()) or follow(exits, most))
    pages = spark.createDataFrame([(1, p, 4) for p in range(1, 40)], "doc_id long, page int, bytes long")
    out = extraction.pack_pages(pages, 9, most=6, block=8).collect()
    assert sorted((r.first_page, r.last_page) for r in out) == [(p, min(p + 1, 39)) for p in range(1, 40, 2)]
    # Two pages fit: no more than two are ever open, and the tables stay as long as before.
    assert seen and all(len(r.exit) == 6 and not any(r.exit[3:]) for r in seen)
    assert any(any(r.exit[:3]) for r in seen)
