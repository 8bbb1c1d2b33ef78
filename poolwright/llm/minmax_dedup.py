"""Near-duplicate documents by min-max hashing.

A document is its set of distinct word shingles. Under each permutation both the
smallest and the largest value are kept, so K evaluations give 2 K signature values,
each of which two sets share with a probability equal to their similarity. Values are
banded; documents that agree on a whole band meet in a bucket.

1. Documents with the same set are one node, however many copies there are.
2. Buckets with two nodes or more are laid out in units: chunks of at most about
   ``unit_rows`` members and ``unit_bytes`` of sketches against each other, so that a
   bucket of any size spreads over tasks. A unit compares parity sketches. The parities
   of two sets differ in no more places than the sets do, so the test loses no link, and
   hardly any pair that is not one passes. A sketch has at least two bits for each
   shingle, so that this holds for sets of every size; of two widths the wider is folded.
3. Passing pairs are confirmed on the full shingle sets, and confirmed links make
   components. The first round lets each member name one partner per unit; the
   second one takes every passing pair between members of different components.

With the default 125 permutations (250 values in 50 bands of 5), two documents of
similarity 0.75 fail to meet with a probability of 1.3e-6; more similar ones less.
That holds for large sets. The minimum and the maximum of one permutation hang together
in small ones: with 12 shingles in both sets together it is 3.3e-6. Sets of ``few`` shingles
or less also meet by what is left without one or two of their shingles, which misses no
pair of 11 shingles or less together that is similar enough by the default of 0.75.
Sets are compared by 64-bit hashes of their shingles.

Defined cases: null texts and texts without words are linked with nothing; a text
shorter than a shingle is one shingle; null doc_ids count only where a component has
no other; rows that repeat a doc_id with another text are documents of their own;
other columns ride along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poolwright.llm.common import give_back, may_hold, row_key, small_batches, table, without
from poolwright.llm.components import components
from poolwright.llm.shingles import WIDTH, mix, shingle_sets
from poolwright.operators.ordering import joined_by_share
from poolwright.session import drop, materialize


@dataclass(frozen=True)
class Settings:
    """permutations and rows set the bands; similarity is a fraction of integers.

    ``sketch_bits``, a power of two of at least 64, is the narrowest sketch.
    """

    width: int = WIDTH
    similarity: tuple[int, int] = (75, 100)
    permutations: int = 125
    rows: int = 5
    sketch_bits: int = 2048
    unit_rows: int = 1024
    unit_bytes: int = 8 << 20
    few: int = 11
    seed: int = 1


def signatures(sets: list[np.ndarray], permutations: int, seed: int) -> np.ndarray:
    """One row per set: the smallest and the largest value under each permutation. Sets are not empty."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    at = 0
    while at < len(sets):
        end, tokens = at, 0
        while end < len(sets) and (end == at or tokens + len(sets[end]) <= 32_768):
            tokens += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        heads = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k, f in enumerate(factors):
            v = values * f
            out[at:end, 2 * k] = np.minimum.reduceat(v, heads)
            out[at:end, 2 * k + 1] = np.maximum.reduceat(v, heads)
        at = end
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = signature.shape[1] // rows
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for j in range(rows):
        keys = mix(keys * np.uint64(31) + signature[:, j : bands * rows : rows])
    return keys


def few_keys(tokens: np.ndarray, few: int) -> np.ndarray:
    """Keys of a small set and of its subsets without one shingle, or two where it has more than five.

    Similar sets (0.75) of up to 7 shingles together differ in one of them, of up to 11 in two.
    """
    n = len(tokens)
    if not 3 <= n <= few:
        return np.empty(0, np.uint64)
    own = mix(tokens + np.uint64(0x632BE59BD9B4E019))
    i, j = np.triu_indices(n, 1)
    less = [np.zeros(1, np.uint64), own] + ([own[i] + own[j]] if n > 5 else [])
    return mix(own.sum() - np.concatenate(less))


def parity_sketch(tokens: np.ndarray, least: int) -> bytes:
    """One bit per slot: whether an odd number of the shingles falls into it.

    The width is the first power of two from ``least`` on with two slots for each shingle.
    """
    bits = least
    while bits < 2 * len(tokens):
        bits *= 2
    slots = (mix(tokens + np.uint64(77)) >> np.uint64(20)) % np.uint64(bits)
    return np.packbits((np.bincount(slots.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def node_of(tokens: np.ndarray) -> bytes:
    """128 bits that name a set, whatever the order."""
    pair = np.array([tokens.sum(), mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64)
    return mix(pair + np.uint64(len(tokens))).tobytes()


MARKS = "_id bigint, _row string, _n bigint, _node binary, _bands array<bigint>, _sketch binary"


def _marks(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = list(shingle_sets(batch["_text"], s.width))
                full = [i for i, x in enumerate(sets) if len(x)]
                keys = band_keys(signatures([sets[i] for i in full], s.permutations, s.seed), s.rows).view(np.int64)
                bands: list = [None] * len(sets)
                for i, k in zip(full, keys, strict=True):
                    bands[i] = np.r_[k, few_keys(sets[i], s.few).view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_id"],
                        batch["_row"],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([node_of(x) if len(x) else None for x in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array([parity_sketch(x, s.sketch_bits) if len(x) else None for x in sets], pa.binary()),
                    ],
                    ["_id", "_row", "_n", "_node", "_bands", "_sketch"],
                )
        give_back()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = pa.array([x.view(np.int64) for x in shingle_sets(batch["_text"], width)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["_c"], sets], ["_c", "_set"])
        give_back()

    return run


def _confirm(similarity: tuple[int, int]):
    """Keep the pairs whose full sets are similar enough."""
    part, whole = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = batch["_x"][i].values.to_numpy(), batch["_y"][i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(whole * both >= part * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one a row, in 64-bit words) brought down to ``width`` words: slots that fall together add their parities."""
    while sketches.shape[1] > width:
        sketches = np.bitwise_xor(*np.split(sketches, 2, axis=1))
    return sketches


def _unit_pairs(similarity: tuple[int, int], nearest: bool):
    """Pairs of a unit whose sketches allow the similarity and whose components differ.

    Sets of sizes m and n are similar enough only if the smaller is at least part / whole
    of the larger, and if they differ in at most (whole - part) / (whole + part) of m + n
    places. Rows come sorted by unit; only the rows of one unit are held.
    """
    part, whole = similarity

    def pairs(rows: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        found = []
        node, comp, n, sketch = rows["_c"], rows["_comp"], rows["_n"], rows["_sketch"]
        words = np.fromiter(map(len, sketch), np.int64, len(sketch)) // 8
        right = np.flatnonzero(rows["_chunk"] == rows["_hi"])
        same = rows["_lo"][0] == rows["_hi"][0]
        # The right side by width: its rows, and their sketches at each width that is asked for.
        classes = []
        for w in np.unique(words[right]):
            at = right[words[right] == w]
            classes.append((at, {int(w): np.frombuffer(b"".join(sketch[at]), np.uint64).reshape(len(at), w)}))
        for i in np.flatnonzero(rows["_chunk"] == rows["_lo"]):
            passed = []
            for at, made in classes:
                ask = (comp[at] != comp[i]) & (whole * np.minimum(n[at], n[i]) >= part * np.maximum(n[at], n[i]))
                if same:
                    ask &= at > i
                if not ask.any():
                    continue
                own = int(max(made))
                width = min(own, int(words[i]))
                if width not in made:
                    made[width] = _folded(made[own], width)
                mine = _folded(np.frombuffer(sketch[i], np.uint64).reshape(1, -1), width)
                j = at[ask]
                differ = np.bitwise_count(made[width][ask] ^ mine).sum(1, dtype=np.int64)
                passed.append(node[j[differ * (whole + part) <= (whole - part) * (n[j] + n[i])]])
            others = np.concatenate(passed) if passed else node[:0]
            if len(others):
                found += [(int(node[i]), o) for o in ([int(others.min())] if nearest else others.tolist())]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        out: list[tuple[int, int]] = []

        def emit():
            a = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch[c].to_numpy() for c in ("_key", "_lo", "_hi", "_chunk", "_c", "_comp", "_n")}
            rows["_sketch"] = np.array(batch["_sketch"].to_pylist(), object)
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            new = (np.diff(rows["_key"]) != 0) | (np.diff(rows["_lo"]) != 0) | (np.diff(rows["_hi"]) != 0)
            ends = np.flatnonzero(new) + 1
            start = 0
            for end in ends:
                if end - start > 1:
                    out += pairs({c: v[start:end] for c, v in rows.items()})
                start = end
            held = {c: v[start:].copy() for c, v in rows.items()}
            if len(out) > 10_000:
                yield emit()
                out = []
        if held is not None and len(held["_c"]) > 1:
            out += pairs(held)
        if out:
            yield emit()

    return run


def _candidates(members: DataFrame, s: Settings, nearest: bool) -> DataFrame:
    """Passing pairs (a, b) of the buckets; members: _key, _c, _comp, _n, _sketch."""
    sizes = members.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_m"), F.sum(F.octet_length("_sketch").cast("long")).alias("_bytes"),
        F.min("_comp").alias("_c1"), F.max("_comp").alias("_c2"),
    )
    chunks = F.greatest(F.ceil(F.col("_m") / s.unit_rows), F.least("_m", F.ceil(F.col("_bytes") / s.unit_bytes)))
    sizes = sizes.filter("_c1 <> _c2").select("_key", chunks.cast("int").alias("_chunks"))
    chunk = F.pmod(F.xxhash64("_c", F.lit(s.seed)), F.col("_chunks")).cast("int")
    units = (
        members.join(sizes, "_key")
        .withColumn("_chunk", chunk)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .select("_key", F.least("_chunk", "_other").alias("_lo"), F.greatest("_chunk", "_other").alias("_hi"),
                "_chunk", "_c", "_comp", "_n", "_sketch")
    )
    unit = ["_key", "_lo", "_hi"]
    pairs = units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_unit_pairs(s.similarity, nearest), "a bigint, b bigint")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: _id, _row, _n (set size), component_id, keep_row (the row of its component that stays)."""
    s = settings
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("_id"), row_key(doc_id, text).alias("_row"), F.col(text).alias("_text"))
    marks = materialize(source.mapInArrow(_marks(s), MARKS).withColumn("_d", F.monotonically_increasing_id()))

    # Nodes: documents with one set. A node is named by its first document.
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))
    nodes = materialize(
        marks.filter("_node is not null").groupBy("_node")
        .agg(F.min("_d").alias("_c"), first.alias("_first"), F.count(F.lit(1)).alias("_copies"))
    )
    own = marks.join(nodes.select("_c").hint("merge"), F.col("_d") == F.col("_c"))
    keyed = own.select("_c", F.explode("_bands").alias("_key"))
    shared = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("_key")
    buckets = materialize(keyed.join(shared.hint("merge"), "_key", "left_semi"))
    sketches = own.select("_c", "_n", "_sketch").join(buckets.select("_c").distinct().hint("merge"), "_c", "left_semi")
    members = materialize(buckets.join(sketches.hint("merge"), "_c"))
    drop(buckets)

    near = _candidates(members.withColumn("_comp", F.col("_c")), s, nearest=True)
    links, stored = None, []
    for nearest in (True, False):
        pairs = materialize(near)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("_c")).distinct()
        rows = materialize(marks.select(F.col("_d").alias("_c"), "_row").join(wanted, "_c"))
        asked = may_hold(source.select("_row", "_text"), "_row", rows).filter("_may").select("_row", "_text")
        texts = asked.join(rows.hint("merge"), "_row").select("_c", "_text")
        sets = materialize(texts.mapInArrow(_sets(s.width), "_c bigint, _set array<bigint>"))
        with_x = pairs.join(sets.select(F.col("_c").alias("a"), F.col("_set").alias("_x")).hint("merge"), "a")
        with_both = with_x.join(sets.select(F.col("_c").alias("b"), F.col("_set").alias("_y")).hint("merge"), "b")
        confirmed = materialize(with_both.select("a", "b", "_x", "_y").mapInArrow(_confirm(s.similarity), "a bigint, b bigint"))
        drop(sets, pairs)
        links = confirmed if links is None else links.unionByName(confirmed)
        labels = components(links)
        if not nearest:
            break
        labelled = members.join(labels, F.col("_c") == F.col("node"), "left").withColumn("_comp", F.coalesce("comp", "_c"))
        near = _candidates(labelled.drop("node", "comp"), s, nearest=False)

    # Copies and components of any size: rows learn of theirs without meeting in one task.
    known = nodes.join(labels, F.col("_c") == F.col("node"), "left")
    classes = materialize(known.select("_node", "_first", "_copies", F.coalesce("comp", "_c").alias("_comp")))
    lowest = materialize(classes.groupBy("_comp").agg(F.min("_first").alias("_low"), F.count(F.lit(1)).alias("_nodes")))
    named = joined_by_share(classes, lowest, ["_comp"], "_nodes")
    named = materialize(named.select("_node", "_copies", F.col("_low._id").alias("_of"), F.col("_low._row").alias("_stays")))
    found = joined_by_share(marks.filter("_node is not null"), named, ["_node"], "_copies")
    return found.select("_id", "_row", "_n", F.col("_of").alias("component_id"), F.col("_stays").alias("keep_row")).unionByName(
        marks.filter("_node is null").select("_id", "_row", "_n", F.col("_id").alias("component_id"), F.col("_row").alias("keep_row"))
    )


def unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns. Texts without words all stay."""
    found = materialize(near_duplicates(docs, doc_id, text, **options))
    times = F.when(F.first("_n") == 0, F.count(F.lit(1))).when(F.first(F.col("_row") == F.col("keep_row")), 1).otherwise(0)
    counts = found.groupBy("_row").agg(times.cast("long").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    return without(docs, doc_id, text, counts.select("_row", "_times"), counts.filter("_times < _rows"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
