"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences
already. The others are dealt to partitions of about ``rows_each`` pieces; each
partition is packed by best-fit decreasing and compared with a lower bound on the
sequences it needs, the best of two families of dual feasible functions. What a
partition has above its bound is its gap. Partitions with a gap give up their
emptiest sequences, which meet those of other partitions in new, fewer partitions
and are packed again, until one partition is left. A repacking that needs as many
sequences as before is not taken, so no round makes it worse.

Defined cases: a null or empty text is its end mark alone; only pieces, not texts,
move; rows that repeat a doc_id are documents of their own; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from poolwright.llm.common import give_back, parts_for, small_batches, table
from poolwright.llm.tokens import encoder
from poolwright.session import materialize

CAPACITY = 2048
END = 0
ROWS_EACH = 8_192
GIVE_UP = 4  # sequences given up for each one of the gap


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first one takes what is over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(
    docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = CAPACITY,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for."""
    small_batches(docs.sparkSession)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType)]
        + [T.StructField(c, T.LongType() if c != "piece" else T.IntegerType()) for c in ("piece", "start", "length", "ids_crc32")]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path)
        end = np.array([END], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                of, rows, ids = [], [], []
                for i, value in enumerate(batch["_text"]):
                    data = encode.ids(value.as_py() or "") + end
                    for k, (start, length) in enumerate(cut_pieces(len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + length)]
                        of.append(i)
                        rows.append((k, start, length, zlib.crc32(own)))
                        if with_ids:
                            ids.append(own)
                numbers = np.array(rows, np.int64).reshape(-1, 4)
                columns = [batch["_id"].take(pa.array(of, pa.int64())), pa.array(numbers[:, 0].astype(np.int32))]
                columns += [pa.array(numbers[:, j]) for j in (1, 2, 3)]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        give_back()

    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece: longest first, each into the fullest sequence that takes it."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r of rooms: some sequence has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at, used = capacity, used, used + 1
        sequence[i], offset[i] = at, capacity - room
        if room > n:
            by_room[room - n].append(at)
            rooms |= 1 << (room - n)
    return sequence, offset


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """A real number that no packing goes below; counts[n]: pieces of length n, up to capacity.

    Dual feasible functions keep the sum over any sequence within the capacity. First
    family: lengths below t count nothing, those above capacity - t count fully.
    Second: for k, floor((k + 1) n / capacity) / k of the capacity, and n itself where
    that is no rounding.
    """
    n = np.arange(capacity + 1)
    mass = np.r_[0, np.cumsum(counts * n)]
    number = np.r_[0, np.cumsum(counts)]
    t = np.arange(0, capacity // 2 + 1)
    middle = mass[capacity - t + 1] - mass[t]
    best = float((middle + (number[-1] - number[capacity - t + 1]) * capacity).max() / capacity)
    for k in range(1, 65):
        times = (k + 1) * n
        value = np.where(times % capacity == 0, n / capacity, times // capacity / k)
        best = max(best, float(counts @ value))
    return best - 1e-9


def _pack_group(capacity: int, release: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lengths = group["length"].to_numpy()
        order = np.lexsort((group["_p"].to_numpy(), -lengths))
        group, lengths = group.take(pa.array(order)), lengths[order]
        was = group["_sequence"].to_numpy(zero_copy_only=False)
        sequence, offset = best_fit_decreasing(lengths, capacity)
        n = int(sequence.max()) + 1
        old = np.unique(was)
        if group["_round"][0].as_py() > 1 and n >= len(old):  # nothing gained: as it was
            sequence, offset, n = np.searchsorted(old, was), group["_offset"].to_numpy(), len(old)
        fill = np.bincount(sequence, weights=lengths, minlength=n)
        gap = n - int(np.floor(lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)))
        open_ = np.zeros(n, bool)
        if release and gap > 0:
            open_[np.argsort(fill, kind="stable")[: GIVE_UP * gap]] = True
        number = group["_round"].to_numpy() * (1 << 56) + group["_g"].to_numpy().astype(np.int64) * (1 << 20) + sequence
        keep = [c for c in group.column_names if c not in ("_sequence", "_offset", "_round", "_g", "_open")]
        out = group.select(keep)
        return (
            out.append_column("_sequence", pa.array(number))
            .append_column("_offset", pa.array(offset.astype(np.int64)))
            .append_column("_open", pa.array(open_[sequence]))
        )

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, rows_each: int = ROWS_EACH) -> DataFrame:
    """Pieces (any columns, among them length) with sequence_id and offset.

    Rounds go on until the pieces that were given up fit into one group, or a round leaves as many open as it got.
    """
    columns = found.columns
    stored = materialize(found.withColumn("_p", F.monotonically_increasing_id()))
    placed = [stored.filter(F.col("length") == capacity).select(*columns, (-1 - F.col("_p")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo = stored.filter(F.col("length") < capacity).withColumn("_sequence", F.lit(-1).cast("long")).withColumn("_offset", F.lit(0).cast("long"))
    schema = T.StructType([*stored.schema.fields, T.StructField("_sequence", T.LongType()), T.StructField("_offset", T.LongType()), T.StructField("_open", T.BooleanType())])
    key = F.xxhash64("_p")
    before = None
    for number in itertools.count(1):
        rows = todo.count()
        groups = parts_for(rows, rows_each)
        last = groups == 1 or rows == before
        before = rows
        dealt = todo.withColumn("_g", F.pmod(key, F.lit(groups)).cast("long")).withColumn("_round", F.lit(number).cast("long"))
        result = materialize(dealt.groupBy("_g").applyInArrow(_pack_group(capacity, not last), schema))
        placed.append(result.filter("not _open").select(*columns, F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset")))
        if last:
            break
        todo = result.filter("_open").drop("_open")
        key = F.xxhash64("_sequence")  # sequences that were given up move whole
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def certificate(found: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, sequences that any packing needs). The histogram of lengths has at most ``capacity`` rows."""
    counts = np.zeros(capacity + 1)
    for row in found.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return packed.select("sequence_id").distinct().count(), int(np.ceil(lower_bound(counts, capacity)))


def sequences(packed: DataFrame, found: DataFrame) -> DataFrame:
    """The token ids of each sequence in order; ``found`` are pieces with ids."""
    whole = packed.join(found.select("doc_id", "piece", "start", "ids"), ["doc_id", "piece", "start"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # bounded by the capacity
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return whole.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Tokenise with the public byte-level vocabulary, then pack."""
    import public_tokenizers

    found = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pack(found)


def op3(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
