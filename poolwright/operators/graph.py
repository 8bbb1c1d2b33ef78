"""Device graphs: parse, sanitise, edit, and keep baseline and manual state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.functions.text import clip, trim_space
from poolwright.operators.ordering import enough_parts, first_rows
from poolwright.session import materialize

MOST_NODES, MOST_PORTS, MOST_EDGES = 200, 24, 600
ID_BYTES, NAME_BYTES, SYMBOL_BYTES = 64, 120, 16
NOTE_BYTES, LABEL_BYTES, KEY_BYTES = 2000, 100, 128
MOST_COORD = 20_000.0
#: Answers that one task reads.
ANSWERS_A_PART = 20_000


def clamp(c: Column | str) -> Column:
    """A coordinate inside the canvas; what is no number counts as 0."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(F.isnan(c), 0.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(MOST_COORD)))


def _first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row by ``ord`` of each key; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("_r")).select(*keys, "_r.*")


def sanitise_nodes(nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """``nodes``: graph_id, ord, id, name, symbol, x, y. The cap counts rows before any is dropped."""
    capped = first_rows(nodes, ["graph_id"], ["ord"], most)
    clean = capped.select(
        "graph_id",
        "ord",
        clip("id", ID_BYTES).alias("id"),
        clip("name", NAME_BYTES).alias("name"),
        clip("symbol", SYMBOL_BYTES).alias("symbol"),
        clamp("x").alias("x"),
        clamp("y").alias("y"),
    ).filter(F.col("id") != "")
    return _first_of(clean, ["graph_id", "id"])


def sanitise_ports(ports: DataFrame, nodes: DataFrame, most: int = MOST_PORTS) -> DataFrame:
    """``ports``: graph_id, node_ord, ord, id, name. ``nodes``: the sanitised ones.

    Output adds ``node``, the id of the owning node. Ports of dropped nodes go.
    """
    owner = nodes.select("graph_id", F.col("ord").alias("node_ord"), F.col("id").alias("node"))
    # The cap counts inside a node, so ports of dropped nodes can go before it: only the few that are left are sorted.
    # The kept nodes are the side that is held; the ports stream past them.
    owned = ports.join(owner.hint("shuffle_hash"), ["graph_id", "node_ord"])
    clean = first_rows(owned, ["graph_id", "node_ord", "node"], ["ord"], most).select(
        "graph_id", "node_ord", "ord", clip("id", ID_BYTES).alias("id"), clip("name", NAME_BYTES).alias("name"), "node"
    ).filter(F.col("id") != "")
    return _first_of(clean, ["graph_id", "node", "id"])


def sanitise_edges(edges: DataFrame, ports: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """``edges``: graph_id, ord, id, from_node, from_port, to_node, to_port, label.

    An edge stays when both its ends are ports of ``ports`` (the sanitised ones). A missing or
    repeated id is replaced by one derived from the edge's place, so that reruns agree.
    """
    # Where the cap falls is found on the narrow columns, so that only edges up to there are sorted whole.
    last = first_rows(edges.select("graph_id", "ord"), ["graph_id"], ["ord"], most).groupBy("graph_id").agg(F.max("ord").alias("_last"))
    near = edges.join(last, "graph_id").filter(F.coalesce(F.col("ord") <= F.col("_last"), F.lit(True))).select(*edges.columns)
    capped = first_rows(near, ["graph_id"], ["ord"], most)
    ends = ["from_node", "from_port", "to_node", "to_port"]
    clean = capped.select(
        "graph_id",
        "ord",
        clip("id", ID_BYTES).alias("id"),
        *[clip(e, ID_BYTES).alias(e) for e in ends],
        clip("label", NAME_BYTES).alias("label"),
    )
    known = ports.select("graph_id", "node", "id")
    for side in ("from", "to"):
        end = known.toDF("graph_id", f"{side}_node", f"{side}_port")
        clean = clean.join(end, ["graph_id", f"{side}_node", f"{side}_port"], "left_semi")
    return renew_ids(clean)


def renew_ids(edges: DataFrame) -> DataFrame:
    """Keep the first bearer of each id; give every other edge an id of its own."""
    # Edges without an id match nothing: by their place they spread over the tasks of the join.
    salt = F.when(F.col("id") == "", F.col("ord")).otherwise(-1).cast("long")
    firsts = edges.filter(F.col("id") != "").groupBy("graph_id", "id").agg(F.min("ord").alias("_first"), F.lit(-1).cast("long").alias("_salt"))
    fresh = F.substring(F.sha2(F.concat_ws(":", "graph_id", "ord"), 256), 1, 16)
    kept = F.col("_first").isNotNull() & (F.col("ord") == F.col("_first"))
    return (
        edges.withColumn("_salt", salt).join(firsts, ["graph_id", "id", "_salt"], "left")
        .withColumn("id", F.when(kept, F.col("id")).otherwise(fresh))
        .select(*edges.columns)
    )


def delete_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes in ``gone`` (graph_id, node)."""
    for side in ("from_node", "to_node"):
        edges = edges.join(gone.select("graph_id", F.col("node").alias(side)), ["graph_id", side], "left_anti")
    return edges


def distinct_cables(edges: DataFrame) -> DataFrame:
    """The first edge between any two ports, whichever way round it was drawn."""
    a = F.struct(F.col("from_node").alias("node"), F.col("from_port").alias("port"))
    b = F.struct(F.col("to_node").alias("node"), F.col("to_port").alias("port"))
    ends = edges.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    # Nearly every edge can be a cable of its own, so that combining before the shuffle leaves as many rows: parts grow in number, not in size.
    with enough_parts(edges.sparkSession, edges.count()):
        return materialize(_first_of(ends, ["graph_id", "_lo", "_hi"]).select(*edges.columns))


ELEMENT = {"id": "string", "name": "string", "symbol": "string", "x": "double", "y": "double"}
EDGE = {"id": "id", "from_node": "from", "from_port": "fromPort", "to_node": "to", "to_port": "toPort", "label": "label"}


def parse_answers(answers: DataFrame, key: str = "graph_id", output: str = "output") -> DataFrame:
    """Read the JSON between the first ``{`` and the last ``}`` of an answer.

    Output: key, usable, note, nodes, edges, the last two as ``array<variant>``. What is not
    an array counts as empty; an answer without readable JSON is not usable. What was read
    is stored: whoever takes nodes, ports and edges from it does not read the JSON again.
    """
    out = F.col("_out")
    first = F.instr(out, "{")
    last = F.length(out) - F.instr(F.reverse(out), "}") + 1
    whole = (first > 0) & (F.instr(out, "}") > 0) & (last > first)
    body = F.when(whole, F.substr(out, first, last - first + 1))
    # Many short answers fit into one file: they are dealt over tasks by their number.
    dealt = answers.select(key, F.coalesce(F.col(output), F.lit("")).alias("_out")).repartition(max(1, -(-answers.count() // ANSWERS_A_PART)))
    parsed = dealt.select(key, F.try_parse_json(body).alias("v"))

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit(""))

    def items(path: str) -> Column:
        found = F.when(kind(path).startswith("ARRAY"), F.try_variant_get("v", path, "array<variant>"))
        return F.coalesce(found, F.array().cast("array<variant>"))

    note = F.when(kind("$.note") == "STRING", F.try_variant_get("v", "$.note", "string"))
    found = parsed.select(
        key,
        F.col("v").isNotNull().alias("usable"),
        F.coalesce(note, F.lit("")).alias("note"),
        items("$.nodes").alias("nodes"),
        items("$.edges").alias("edges"),
    )
    return materialize(found)


def _field(v: str, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def answer_nodes(parsed: DataFrame, key: str = "graph_id") -> DataFrame:
    rows = parsed.select(key, F.posexplode("nodes").alias("ord", "v"))
    return rows.select(key, "ord", *[_field("v", n, t).alias(n) for n, t in ELEMENT.items()])


def answer_ports(parsed: DataFrame, key: str = "graph_id") -> DataFrame:
    rows = parsed.select(key, F.posexplode("nodes").alias("node_ord", "n"))
    ports = rows.select(
        key, "node_ord", F.posexplode(F.try_variant_get("n", "$.ports", "array<variant>")).alias("ord", "v")
    )
    return ports.select(key, "node_ord", "ord", _field("v", "id", "string").alias("id"), _field("v", "name", "string").alias("name"))


def answer_edges(parsed: DataFrame, key: str = "graph_id") -> DataFrame:
    rows = parsed.select(key, F.posexplode("edges").alias("ord", "v"))
    return rows.select(key, "ord", *[_field("v", j, "string").alias(n) for n, j in EDGE.items()])


def generation_outcomes(attempts: DataFrame, node_counts: DataFrame) -> DataFrame:
    """The outcome of each attempt, judged and not trusted.

    ``attempts``: attempt_id, graph_id, state, note, model, engine, source_key.
    ``node_counts``: attempt_id, n, the nodes left after sanitising.
    """
    said = trim_space("state")
    claimed_ok = said.isin("", "ok")
    nodes = F.coalesce("n", F.lit(0))
    state = F.when(claimed_ok & (nodes > 0), "ok").when(said == "failed", "failed").otherwise("empty")
    # The counts are narrow and are the side that is held; the attempts, cut to size before they travel, stream past without a sort.
    cut = attempts.select(
        "attempt_id",
        "graph_id",
        "state",
        clip("note", NOTE_BYTES).alias("note"),
        clip("model", LABEL_BYTES).alias("model"),
        clip("engine", LABEL_BYTES).alias("engine"),
        clip("source_key", KEY_BYTES).alias("source_key"),
    )
    counts = node_counts.select("attempt_id", "n").hint("shuffle_hash")
    return cut.join(counts, "attempt_id", "left").select(
        "attempt_id",
        "graph_id",
        state.alias("state"),
        nodes.cast("long").alias("nodes"),
        "note",
        "model",
        "engine",
        "source_key",
    )


ATTEMPTS = ("ok", "empty", "failed")


def fold_graphs(events: DataFrame, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """The state of each graph from its log, batch or stream.

    ``events``: graph_id, the order columns, kind (ok, empty, failed, manual, restore), graph,
    source_key, note, model, engine, at. The baseline is the last derived graph. The visible
    one is the last manual edit while that is newer than the last restore, else the baseline.
    """
    return events.groupBy("graph_id").agg(*graph_columns(order)).select("graph_id", *graph_view())


def graph_columns(order: tuple[str, ...] = ("t",)) -> list[Column]:
    at, kind = F.struct(*order), F.col("kind")
    when = lambda *kinds: F.when(kind.isin(*kinds), at)
    attempt = F.struct("kind", "note", "model", "engine", "at")
    return [
        F.max(when("manual")).alias("_edited"),
        F.max(when("restore")).alias("_restored"),
        F.max_by("graph", when("ok")).alias("doc"),
        F.max_by("graph", when("manual")).alias("_drawn"),
        F.max_by("source_key", when("ok")).alias("source_key"),
        F.max_by("at", when("ok")).alias("generated"),
        F.max_by(attempt, when(*ATTEMPTS)).alias("_last"),
    ]


def graph_view() -> list[Column]:
    edited, restored = F.col("_edited"), F.col("_restored")
    modified = edited.isNotNull() & (restored.isNull() | (edited > restored))
    none = F.lit("")
    return [
        F.col("doc"),
        F.when(modified, F.col("_drawn")).otherwise(F.col("doc")).alias("current"),
        modified.alias("modified"),
        F.when(modified, "manual").otherwise("document").alias("state"),
        F.coalesce("source_key", none).alias("source_key"),
        F.coalesce("generated", F.lit(0)).cast("long").alias("generated"),
        F.coalesce("_last.kind", none).alias("generation"),
        F.coalesce("_last.note", none).alias("note"),
        F.coalesce("_last.model", none).alias("model"),
        F.coalesce("_last.engine", none).alias("engine"),
        F.coalesce("_last.at", F.lit(0)).cast("long").alias("generation_at"),
    ]


def source_keys(docs: DataFrame, most: int = KEY_BYTES) -> DataFrame:
    """The fingerprint of each pool: pool_id, source_key, digest, n.

    ``source_key`` is the sorted ``id:created`` list joined by ``|``, cut to ``most`` bytes. An
    entry has at least two bytes and a bar follows it, so the first ``most / 3`` entries
    already fill it, and no pool is ever collected whole. ``digest`` covers every entry: it is
    independent of order, so it combines before the shuffle.
    """
    entry = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("created").cast("string"))
    rows = docs.select("pool_id", entry.alias("entry"))
    head = first_rows(rows, ["pool_id"], ["entry"], most // 3 + 1)
    joined = F.array_join(F.sort_array(F.collect_list("entry")), "|")
    keys = head.groupBy("pool_id").agg(clip(joined, most).alias("source_key"))
    digits = F.conv(F.substring(F.md5("entry"), 1, 15), 16, 10).cast("long")
    whole = rows.groupBy("pool_id").agg(F.bit_xor(digits).alias("digest"), F.count(F.lit(1)).alias("n"))
    return keys.join(whole, "pool_id")


def stale(docs: DataFrame, graphs: DataFrame) -> DataFrame:
    """Pools whose documents changed since their graph was derived.

    ``graphs``: pool_id, digest, n: digest and number of entries at that time. Equal entries cancel in
    the digest, so the number counts too.
    """
    now = source_keys(docs).select("pool_id", F.col("digest").alias("_now"), F.col("n").alias("_n_now"))
    same = F.col("digest").eqNullSafe(F.col("_now")) & F.col("n").eqNullSafe(F.col("_n_now"))
    return graphs.join(now, "pool_id", "left").select("pool_id", (~same).alias("stale"))
