"""How many parts, and how many readings, a growing table makes."""

from pyspark.sql import functions as F

from poolwright.operators import extraction, graph, ordering

PARTS = "spark.sql.shuffle.partitions"


def test_parts_grow_with_the_rows(spark):
    before = spark.conf.get(PARTS)
    with ordering.enough_parts(spark, 1_001, 100):
        assert spark.conf.get(PARTS) == "11"
    with ordering.enough_parts(spark, 1, 100):
        assert spark.conf.get(PARTS) == before
    assert spark.conf.get(PARTS) == before


def test_cables_are_dealt_by_their_number(spark, monkeypatch):
    asked = []
    kept = graph.enough_parts
    monkeypatch.setattr(graph, "enough_parts", lambda s, rows: asked.append(rows) or kept(s, rows, 100))
    edges = spark.range(1_000).select(
        F.lit("g").alias("graph_id"), F.col("id").alias("ord"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit("a"), F.col("id") % 400).alias("from_node"), F.lit("1").alias("from_port"),
        F.lit("z").alias("to_node"), F.lit("1").alias("to_port"), F.lit("").alias("label"),
    )
    assert sorted(r.ord for r in graph.distinct_cables(edges).collect()) == list(range(400))
    assert asked == [1_000]


def test_answers_are_dealt_and_read_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "ANSWERS_A_PART", 10)
    text = F.concat(F.lit('so {"nodes":[{"id":"n'), F.col("id"), F.lit('"}],"edges":[]}'))
    parsed = graph.parse_answers(spark.range(0, 100, 1, 1).select(F.col("id").alias("graph_id"), text.alias("output")))
    assert len(parsed.inputFiles()) == 10  # stored, a file for each part
    nodes = graph.answer_nodes(parsed)
    assert sorted((r.graph_id, r.id) for r in nodes.collect()) == [(i, f"n{i}") for i in range(100)]
    assert "parse_json" not in nodes._jdf.queryExecution().optimizedPlan().toString()


def test_states_are_dealt_by_the_number_of_results(spark, monkeypatch):
    asked = []
    kept = extraction.enough_parts
    monkeypatch.setattr(extraction, "enough_parts", lambda s, rows: asked.append(rows) or kept(s, rows, 10))
    plans = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(2).alias("total"), F.lit(False).alias("has_text"), F.lit(True).alias("has_ai"))
    results = plans.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"), F.lit("read").alias("outcome"), F.lit(True).alias("legible"))
    assert {(r.state, r.total) for r in extraction.final_state(plans, results).collect()} == {("ready", 0)}
    assert asked == [100]
