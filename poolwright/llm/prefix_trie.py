"""The trie of conversation prefixes, with totals of every subtree.

A node is a distinct sequence of first turns; its members are the conversations that
start with it, and the smallest of them names it: (conv_id, depth) is a key, and a
parent always lies before its children in that order. Sequences are told apart by
four running sums of 32 random bits a turn (128 bits; a false merge is improbable, about
n^2 / 2^129 among n nodes), so no text is shuffled and no task holds a conversation.

Totals come by time-forward processing. Nodes are cut into ranges of (conv_id, depth),
the shards. Spark sorts each shard in reverse level order, outside memory where
needed; every node takes what its children left for it in a priority queue, which
spills sorted runs, and leaves its own total to its parent. What is left for a parent
in another shard is summed there. These targets, each under the next target that its
total flows to, are again a forest of nodes: they go through the same shards and
queues, and then every shard runs once more with what came from outside.

Defined cases: turns without a conv_id belong to no conversation and are left out; a
null role or text is empty; turns of equal number (null first) are ordered by a digest
of role and text, so ties and repeated rows agree between runs; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm.common import parts_for, table
from poolwright.operators.ordering import running
from poolwright.session import materialize

NODES_EACH = 100_000
WAITING = 200_000
PIECE = 1 << 16  # bytes of joined ids in one row
SEEDS = (11, 12)
SUMS = ("_s0", "_s1", "_s2", "_s3")

_TOTALS = "conv long, depth long, leaves long, saved long"
_EXITS = "_shard int, conv long, pconv long, pdepth long"


def turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Narrow rows (conv, pos, _e0, _e1, chars): the place of each turn, two digests and the size of its text."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.filter(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("_turn"),
        *[F.xxhash64(F.lit(seed), *said).alias(f"_e{i}") for i, seed in enumerate(SEEDS)],
        F.char_length(said[1]).cast("long").alias("chars"),
    )
    return running(rows, ["conv"], [F.col("_turn").asc_nulls_first(), "_e0", "_e1"], "pos").drop("_turn")


def grafted(rows: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Every conversation c with the first h turns of c - c % ``block`` in place of its own; h = crc32(c) % (``most`` + 1).

    Takes and returns the rows of ``turns``; pos is the new place. A conversation that keeps no turn has one row of pos 0.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("long")
    heads = rows.filter(F.col("pos") <= most).select(F.col("conv").alias("_base"), "pos", "_e0", "_e1", "chars")
    convs = rows.filter("pos = 1").select("conv", h.alias("_h"), (F.col("conv") - F.col("conv") % block).alias("_base"))
    # at most ``block`` conversations share a base, and each takes ``most`` rows of it
    taken = materialize(convs.join(heads, "_base").filter("pos <= _h").select("conv", "pos", "_e0", "_e1", "chars"))
    sizes = taken.groupBy("conv").agg(F.count(F.lit(1)).alias("_b"))
    own = rows.withColumn("_h", h).filter("pos > _h").join(sizes, "conv", "left")
    own = own.withColumn("pos", F.col("pos") - F.col("_h") + F.coalesce("_b", F.lit(0)))
    none = convs.select("conv", F.lit(0).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(c) for c in ("_e0", "_e1", "chars")])
    return taken.unionByName(own.select("conv", "pos", "_e0", "_e1", "chars")).unionByName(none)


def _key(sums: list[Column], name: str) -> list[Column]:
    return [F.xxhash64(*sums[:2]).alias(f"{name}1"), F.xxhash64(*sums[2:]).alias(f"{name}2")]


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars, last): the key of each prefix and of the one before it.

    ``rows``: (conv, pos, _e0, _e1, chars), with a row of pos 0 for each conversation.
    """
    parts = {}
    for i in range(2):
        word = F.when(F.col("pos") > 0, F.xxhash64(F.lit(SEEDS[i]), f"_e{i}", "pos")).otherwise(F.lit(0))
        parts[f"_m{2 * i}"], parts[f"_m{2 * i + 1}"] = F.shiftrightunsigned(word, 32), word.bitwiseAND(F.lit(0xFFFFFFFF))
    rows = rows.select("conv", "pos", "chars", *[c.cast("long").alias(n) for n, c in parts.items()])
    summed = running(rows, ["conv"], ["pos"], "_at", {s: F.col(f"_m{i}") for i, s in enumerate(SUMS)})
    now, before = [F.col(s) for s in SUMS], [F.col(s) - F.col(f"_m{i}") for i, s in enumerate(SUMS)]
    return summed.select("conv", F.col("pos").alias("depth"), "chars", *_key(now, "k"), *_key(before, "p"))


def _ids(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, depth, conv) to strings of at most PIECE bytes of ids of one node."""
    out, key, first, text, size = [], None, None, [], 0
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def made():
        done = pa.RecordBatch.from_pylist(out, schema)
        out.clear()
        return done

    def close():
        if text:
            out.append(dict(zip(("k1", "k2", "depth"), key, strict=True), first=first, ids=",".join(text)))

    for batch in rows:
        for *node, conv in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "depth", "conv")), strict=True):
            if node != key or size > PIECE:
                close()
                key, first, text, size = node, conv, [], 0
            text.append(str(conv))
            size += len(text[-1]) + 1
        if len(out) >= 2000:
            yield made()
    close()
    if out:
        yield made()


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of ids to one SHA-256 for each node; the pieces of a node pass one after the other."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())])
    key, state = None, None
    for batch in rows:
        out = []
        for *node, ids in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "depth", "ids")), strict=True):
            if node != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest()), strict=True))], schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, conv) to the SHA-256 of each node's ids, ascending and joined by commas.

    SHA-256 reads its input in order, so a node's ids have to pass one task; they do so as
    strings of PIECE bytes that range-sorted tasks have joined, and none is held.
    """
    order = ["k1", "k2", "depth", "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(_ids, "k1 long, k2 long, depth long, first long, ids string")
    keys = ["k1", "k2", "depth"]
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(_digests, "k1 long, k2 long, depth long, ends string")


def nodes(prefixes: DataFrame) -> DataFrame:
    """One stored row per node: conv, depth, pconv, n_convs, n_children, own (saved by itself), ends."""
    keys = ["k1", "k2", "depth"]
    found = materialize(
        prefixes.groupBy(*keys).agg(
            F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
            F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        )
    )
    above = found.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("pconv"))
    kids = found.filter("depth > 0").groupBy("p1", "p2", "depth").agg(F.count(F.lit(1)).alias("n_children"))
    kids = kids.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"), "n_children")
    last = prefixes.groupBy("conv").agg(F.max_by(F.struct(*keys), "depth").alias("_last")).select("conv", "_last.*")
    joined = found.join(kids, keys, "left").join(end_digests(last), keys, "left")
    # A parent of many children is a hot key here; the join's output goes straight to storage, so Spark may split it.
    joined = joined.join(above, ["p1", "p2", "depth"], "left")
    return materialize(
        joined.select(
            "conv", "depth", F.when(F.col("depth") > 0, F.col("pconv")).alias("pconv"), "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("own"),
            F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends"),
        )
    )


class Waiting:
    """A priority queue of (key, leaves, saved) that holds at most ``most`` entries; the rest lies in sorted runs.

    A run is an unnamed file of the task's own, as those of Spark's sorts: it goes with
    the task, no other task reads it, and a task that is run again writes its own.
    """

    def __init__(self, most: int = WAITING):
        self.most, self.heap, self.heads, self.runs = most, [], [], []

    def push(self, key: tuple, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (key, leaves, saved))
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()
            self.heap.sort()
            for at in range(0, len(self.heap), 4096):
                pickle.dump(self.heap[at : at + 4096], run)
            run.seek(0)
            self.heap = []
            self.runs.append(self._read(run))
            self._next(len(self.runs) - 1)

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def _next(self, at: int) -> None:
        entry = next(self.runs[at], None)
        if entry is not None:
            heapq.heappush(self.heads, (entry, at))

    def take(self, key: tuple) -> tuple[int, int]:
        """The sums of all that waits under ``key``, which is the smallest key that can be left."""
        leaves = saved = 0
        while self.heap and self.heap[0][0] == key:
            _, a, b = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.heads and self.heads[0][0][0] == key:
            (_, a, b), at = heapq.heappop(self.heads)
            leaves, saved = leaves + a, saved + b
            self._next(at)
        return leaves, saved


_COLUMNS = ("_shard", "conv", "depth", "pconv", "pdepth", "leaves", "saved", "_lo")


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, each: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == each:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _forward(send: bool, most: int):
    """Rows in reverse level order to totals: of each node, or (``send``) what goes to parents outside the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            shard, queue = None, None
            for at, conv, depth, pconv, pdepth, leaves, saved, lo in _rows(batches, _COLUMNS):
                if at != shard:
                    shard, queue = at, Waiting(most)
                more = queue.take((-depth, conv))
                leaves, saved = leaves + more[0], saved + more[1]
                if not send:
                    yield conv, depth, leaves, saved
                if pconv is None:
                    continue
                if (pconv, pdepth) >= (lo["conv"], lo["depth"]):
                    queue.push((-pdepth, pconv), leaves, saved)
                elif send:
                    yield pconv, pdepth, leaves, saved

        yield from _batches(rows(), pa.schema([(n, pa.int64()) for n in ("conv", "depth", "leaves", "saved")]))

    return run


def _leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard in the order of (conv, depth): where what enters a chain (a conversation's nodes) leaves the shard."""

    def rows() -> Iterator[tuple]:
        shard, exits = None, {}  # one entry for each chain of the shard, which NODES_EACH bounds
        for at, conv, _, pconv, pdepth, _, _, lo in _rows(batches, _COLUMNS):
            if at != shard:
                shard, exits = at, {}
            if conv not in exits:
                inside = pconv is not None and (pconv, pdepth) >= (lo["conv"], lo["depth"])
                exits[conv] = exits[pconv] if inside else (pconv, pdepth)
                yield at, conv, *exits[conv]

    kinds = (("_shard", pa.int32()), ("conv", pa.int64()), ("pconv", pa.int64()), ("pdepth", pa.int64()))
    yield from _batches(rows(), pa.schema(list(kinds)))


def totals(tree: DataFrame, nodes_each: int = NODES_EACH, waiting: int = WAITING) -> DataFrame:
    """(conv, depth, pconv, pdepth, leaves, saved) to (conv, depth, leaves, saved) summed over subtrees.

    Parents come before their children in the order of (conv, depth) and have a smaller depth.
    A chain (the nodes of one conv) is linked: each of its nodes but the first has the one before as its parent, or an ancestor of it.
    """
    shards = parts_for(tree.count(), nodes_each)
    order = ["conv", "depth"]
    placed = materialize(tree.repartitionByRange(shards, *order).withColumn("_shard", F.spark_partition_id()))
    lows = placed.groupBy("_shard").agg(F.min(F.struct(*order)).alias("_lo"))

    def in_order(rows: DataFrame, *by) -> DataFrame:
        rows = rows.join(lows, "_shard").select(*_COLUMNS)
        return rows.repartition(shards, "_shard").sortWithinPartitions("_shard", *by)

    def forward(rows: DataFrame, send: bool) -> DataFrame:
        return in_order(rows, F.desc("depth"), "conv").mapInArrow(_forward(send, waiting), _TOTALS)

    if shards == 1:
        return forward(placed, False)
    late = forward(placed, True).groupBy(*order).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    late = late.join(placed.select(*order, "_shard"), order)
    exits = in_order(placed, *order).mapInArrow(_leave, _EXITS)
    across = materialize(late.join(exits, ["_shard", "conv"]).select(*order, "pconv", "pdepth", "leaves", "saved"))
    # A leaf is no target, so there are fewer targets than nodes, and their ranges are wider: targets and what they flow to meet.
    got = totals(across, nodes_each, waiting)
    got = got.withColumnsRenamed({"leaves": "_leaves", "saved": "_saved"})
    whole = placed.join(got, order, "left").withColumn("leaves", F.col("leaves") + F.coalesce("_leaves", F.lit(0)))
    return forward(whole.withColumn("saved", F.col("saved") + F.coalesce("_saved", F.lit(0))), False)


def trie(rows: DataFrame, nodes_each: int = NODES_EACH, waiting: int = WAITING) -> DataFrame:
    """One row per node of conversations given as in ``prefixes``."""
    found = nodes(prefixes(rows))
    tree = found.select(
        "conv", "depth", "pconv", F.when(F.col("pconv").isNotNull(), F.col("depth") - 1).alias("pdepth"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("own").alias("saved"),
    )
    sums = totals(tree, nodes_each, waiting)
    return found.join(sums, ["conv", "depth"]).select(
        F.col("conv").alias("conv_id"), "depth", F.col("pconv").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, nodes_each: int = NODES_EACH, waiting: int = WAITING, **columns: str) -> DataFrame:
    """The trie of conversations as they are."""
    rows = turns(conversations, **columns)
    none = rows.filter("pos = 1").select("conv", *[F.lit(0).cast("long").alias(c) for c in ("pos", "_e0", "_e1", "chars")])
    return trie(rows.unionByName(none), nodes_each, waiting)


def op11(spark, sf_dir: str) -> DataFrame:
    return trie(grafted(turns(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH given AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), talks AS (
  SELECT c, list({'r': r, 't': t} ORDER BY pos) AS said FROM given GROUP BY c
), grown AS (
  SELECT c, c - c % 100 AS base, said,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(c::VARCHAR, '.'), lambda ch: ascii(ch)::BIGINT)),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 6 AS h
  FROM talks
), built AS (
  SELECT g.c, list_concat(coalesce(b.said[:g.h], []), g.said[g.h + 1:]) AS said
  FROM grown g LEFT JOIN talks b ON b.c = g.base
), steps AS (
  SELECT c, said, unnest(range(0, len(said) + 1)) AS depth FROM built
), each AS (
  SELECT c, depth, said[:depth] AS path, len(said) = depth AS ends FROM steps
), node AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(path[depth].t) END AS own
  FROM each GROUP BY path, depth
), kids AS (
  SELECT path[:depth - 1] AS above, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), whole AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children
  FROM node n LEFT JOIN kids k ON k.above = n.path
  LEFT JOIN node p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
), under AS (
  SELECT path[:d] AS top, d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(own) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM whole) GROUP BY ALL
)
SELECT w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN under u ON u.d = w.depth AND u.top = w.path
"""
