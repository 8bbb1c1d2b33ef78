"""What one task holds does not grow with the width of the rows that pass through it."""

from pyspark.sql import functions as F

from poolwright.operators import graph


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_attempts_are_not_sorted_to_meet_their_counts(spark):
    attempts = spark.range(300).select(
        F.col("id").alias("attempt_id"), F.lit(1).alias("graph_id"), F.lit("ok").alias("state"), F.repeat(F.lit("n"), 5000).alias("note"),
        F.lit("m").alias("model"), F.lit(None).cast("string").alias("engine"), F.lit("k").alias("source_key"),
    )
    out = graph.generation_outcomes(attempts, spark.range(0, 300, 2).select(F.col("id").alias("attempt_id"), F.lit(3).alias("n")))
    text = plan(out)
    assert "ShuffledHashJoin" in text and "BuildRight" in text and "SortMergeJoin" not in text
    rows = out.collect()
    assert len(rows) == 300 and {(r.attempt_id % 2, r.state, r.nodes, len(r.note)) for r in rows} == {(0, "ok", 3, 2000), (1, "empty", 0, 2000)}


def test_ports_of_dropped_nodes_go_before_the_cap(spark):
    """Only ports with an owner are numbered; two nodes in one place have a cap each."""
    ports = spark.createDataFrame(
        [("g", n, k, f"{k}", "p") for n in (1, 2, 3) for k in range(4)], "graph_id string, node_ord long, ord int, id string, name string"
    )
    nodes = spark.createDataFrame([("g", "a", 1), ("g", "b", 1), ("g", "c", 3)], "graph_id string, id string, ord long")
    out = graph.sanitise_ports(ports, nodes, 3)
    text = plan(out)
    assert text.index("WindowGroupLimit") < text.index("Join")  # the window reads the join
    assert sorted((r.node, r.id) for r in out.collect()) == [(n, str(k)) for n in "abc" for k in range(3)]


def test_edges_are_cut_by_place_before_they_are_sorted(spark):
    from poolwright.operators import graph

    names = "graph_id string, ord long, id string, from_node string, from_port string, to_node string, to_port string, label string"
    edges = spark.createDataFrame([(g, k, f"{g}{k}", "a", "1", "b", "1", "x") for g in "pq" for k in range(30)], names)
    ports = spark.createDataFrame([(g, n, "1") for g in "pq" for n in "ab"], "graph_id string, node string, id string")
    out = graph.sanitise_edges(edges, ports, 4)
    assert sorted((r.graph_id, r.ord) for r in out.collect()) == [(g, k) for g in "pq" for k in range(4)]
    assert "_last" in out._jdf.queryExecution().optimizedPlan().toString()
    tied = graph.sanitise_edges(edges.withColumn("ord", edges["ord"] * 0), ports, 4)  # places that repeat do not widen the cap
    assert tied.count() == 8
