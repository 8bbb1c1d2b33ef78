"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks. Each chunk has a hash (two polynomials modulo primes
below 2^31) and a shift (the base to the power of its length), and the hash of two
neighbours is ``left * shift(right) + right``. The rule is associative, so chunks of
a huge document can be hashed apart, in any grouping, and combined in order: a text
of more than ``SPREAD`` chunks is cut into blocks of so many, the blocks of all such
texts are dealt over tasks and hashed there, and ``FAN`` neighbours at a time are
combined until one is left. What one row sees of a text is its normalising and SHA-256.

Equal fingerprints are no proof. Documents that share one are compared chunk by
chunk: the smallest and the largest chunk at each place of a fingerprint must be
the same bytes. These two combine in each map task, so a group that holds a third
of all rows reaches the shuffle as one row per task and place. Fingerprints that
fail are grouped by the texts themselves. Rows learn of their group by
``joined_by_share``, so that a large group is not one task's either.

Defined cases: a null text counts as empty; of equal texts the smallest doc_id
stays, a null doc_id only if there is no other; of repeated rows with one doc_id
exactly one stays; other columns ride along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwright.operators.ordering import joined_by_share
from poolwright.llm.common import SPACE, may_hold, packed, plain_reads, row_key, small_batches, table, without
from poolwright.session import materialize

CHUNK = 16_384
SPREAD = 4
FAN = 256
#: No string of Spark has more bytes, so the number of levels of ``FAN`` is known.
LONGEST = 1 << 31
FP = ["n", "h1", "h2"]
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 777_767_777)
CHUNK_TYPE = "array<struct<n:bigint,h1:bigint,s1:bigint,h2:bigint,s2:bigint>>"


def normalised(text: str) -> Column:
    """The text with each run of white space made one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.int64)
    done = 1
    while done <= n:  # doubling: each step appends a shifted copy
        step = min(done, n + 1 - done)
        out[done : done + step] = out[:step] * (pow(base, done, prime)) % prime
        done += step
    return out


def chunk_hasher(chunk: int = CHUNK, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES):
    """A function of (bytes) to the list of (length, hash, shift, hash, shift) of its chunks."""
    tables = [_powers(b, p, chunk)[::-1].copy() for b, p in zip(bases, primes, strict=True)]

    def chunks(data: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        found = []
        for at in range(0, len(data), chunk):
            piece = data[at : at + chunk].astype(np.int64) + 1  # so that a zero byte counts
            n = len(piece)
            row = [n]
            for powers, p in zip(tables, primes, strict=True):
                # piece < 2^9, powers < 2^31, 2^14 terms: the sum stays below 2^54
                row += [int(np.dot(piece, powers[chunk - n + 1 :])) % p, int(powers[chunk - n])]
            found.append(tuple(row))
        return found

    return chunks


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Each value of a string or binary column as bytes, without copies."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]]


def chunk_hashes(text: Column, chunk: int = CHUNK, primes=PRIMES, bases=BASES) -> Column:
    """The hashes of the chunks of ``text``, in order."""

    @F.arrow_udf(CHUNK_TYPE)
    def hashes(texts: pa.Array) -> pa.Array:
        hasher = chunk_hasher(chunk, primes, bases)
        rows, ends = [], [0]
        for data in _texts(texts):
            rows += hasher(data)
            ends.append(len(rows))
        columns = np.array(rows, np.int64).reshape(-1, 5)
        fields = [pa.array(columns[:, i]) for i in range(5)]
        inner = pa.StructArray.from_arrays(fields, ["n", "h1", "s1", "h2", "s2"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)

    return hashes(text)


def combined(chunks: Column, primes=PRIMES) -> Column:
    """Chunks in order as one (n, h1, s1, h2, s2): shift what is there, add the next."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("h1"), one.alias("s1"), zero.alias("h2"), one.alias("s2"))

    def append(a, c):
        return F.struct(
            (a["n"] + c["n"]).alias("n"),
            ((a["h1"] * c["s1"] + c["h1"]) % primes[0]).alias("h1"),
            (a["s1"] * c["s1"] % primes[0]).alias("s1"),
            ((a["h2"] * c["s2"] + c["h2"]) % primes[1]).alias("h2"),
            (a["s2"] * c["s2"] % primes[1]).alias("s2"),
        )

    return F.aggregate(chunks, start, append)


def blocks_hashed(texts: DataFrame, chunk: int = CHUNK, primes=PRIMES, bases=BASES, spread: int = SPREAD) -> DataFrame:
    """The blocks of texts (_row, _text), hashed wherever they fall: _row, _at (from 0), _f.

    Rows that share a _row are equal in text; each of their blocks comes once.
    """
    size = spread * chunk
    data = texts.select("_row", F.col("_text").cast("binary").alias("_data"))
    last = F.greatest(F.lit(0), F.floor((F.length("_data") - 1) / size).cast("int"))
    blocks = (
        data.select("_row", F.explode(F.sequence(F.lit(0), last)).alias("_at"), "_data")
        .select("_row", "_at", F.substring("_data", F.col("_at") * size + 1, F.lit(size)).alias("_block"))
        .repartition("_row", "_at")
    )
    hashed = blocks.select("_row", "_at", combined(chunk_hashes(F.col("_block"), chunk, primes, bases), primes).alias("_f"))
    return hashed.groupBy("_row", "_at").agg(F.min("_f").alias("_f"))


def folded(blocks: DataFrame, primes=PRIMES, size: int = SPREAD * CHUNK, fan: int = FAN) -> DataFrame:
    """Blocks (_row, _at, _f) as one _f per _row: ``fan`` neighbours become one, level by level."""
    left = -(-LONGEST // size)
    while left > 1:
        near = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_f"))), lambda b: b["_f"])  # at most ``fan``
        blocks = blocks.groupBy("_row", F.expr(f"_at div {fan}").cast("int").alias("_to")).agg(combined(near, primes).alias("_f"))
        blocks = blocks.withColumnRenamed("_to", "_at")
        left = -(-left // fan)
    return blocks.select("_row", "_f")


def fingerprints(docs: DataFrame, doc_id: str, text: str, chunk: int, primes, bases, spread: int = SPREAD) -> DataFrame:
    """One narrow row per document: _id, _row, _sha, n, h1, h2."""
    # Normalising never makes a text longer, so its own length tells where blocks are needed.
    long = F.coalesce(F.octet_length(text) > spread * chunk, F.lit(False))
    key = row_key(doc_id, text).alias("_row")
    near = F.when(F.col("_long"), F.lit("")).otherwise(F.col("_text"))
    marks = materialize(
        docs.select(F.col(doc_id).alias("_id"), key, normalised(text).alias("_text"), long.alias("_long"))
        .select("_id", "_row", "_long", F.sha2("_text", 256).alias("_sha"), combined(chunk_hashes(near, chunk, primes, bases), primes).alias("_f"))
    )
    asked = docs.filter(long).select(key, normalised(text).alias("_text"))
    far = materialize(folded(blocks_hashed(asked, chunk, primes, bases, spread), primes, spread * chunk))
    columns = ["_id", "_row", "_sha", *[F.col("_f")[c].alias(c) for c in FP]]
    spread_out = marks.filter("_long").drop("_f").join(far, "_row")
    return marks.filter("not _long").select(columns).unionByName(spread_out.select(columns))


def _keeper() -> list[Column]:
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id")))
    return [first["_id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size")]


def groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    chunk: int = CHUNK, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES, spread: int = SPREAD,
) -> DataFrame:
    """One row per document: _id, _row, keep_id, group_size, kept, text_sha256."""
    small_batches(docs.sparkSession)
    plain_reads(docs.sparkSession)
    marks = materialize(fingerprints(docs, doc_id, text, chunk, primes, bases, spread))
    shared = materialize(marks.groupBy(*FP).agg(*_keeper()))
    known = materialize(joined_by_share(marks, shared, FP, "group_size"))

    # The texts that share a fingerprint, met by row and not by fingerprint: even parts.
    suspects = materialize(known.filter("group_size > 1").select("_row", *FP).distinct())
    texts = docs.select(row_key(doc_id, text).alias("_row"), normalised(text).alias("_text"))
    asked = may_hold(packed(docs, _row=row_key(doc_id, text), _text=text).drop("_in"), "_row", suspects).filter("_may")
    pieces = (
        asked.select("_row", normalised("_text").alias("_text")).join(suspects.hint("merge"), "_row")
        .withColumn("_data", F.col("_text").cast("binary"))
        .select(*FP, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(chunk))).alias("_at"), "_data")
        .select(*FP, "_at", F.substring("_data", F.col("_at") + 1, F.lit(chunk)).alias("_piece"))
    )
    differ = materialize(
        pieces.groupBy(*FP, "_at").agg(F.min("_piece").alias("_a"), F.max("_piece").alias("_b"))
        .filter("_a <> _b").select(*FP).distinct()
    )
    if differ.isEmpty():  # no two texts under one fingerprint
        named = known
    else:
        split = materialize(
            texts.join(marks.select("_row", "_id", *FP).join(differ, FP), "_row")
        )
        owners = split.groupBy(*FP, "_text").agg(*_keeper())
        exact = split.join(owners, [*FP, "_text"]).select("_id", "_row", "keep_id", "group_size").distinct()
        clean = known.join(differ, FP, "left_anti")
        torn = marks.join(differ, FP, "left_semi").join(exact.drop("_id"), "_row")
        columns = ["_id", "_row", "_sha", *FP, "keep_id", "group_size"]
        named = clean.select(columns).unionByName(torn.select(columns))
    return _one_of_each(named)


def _one_of_each(named: DataFrame) -> DataFrame:
    """kept: the first row with the keeping id; rows equal in id and text are numbered to keep one."""
    own = F.row_number().over(Window.partitionBy("_id", "_sha").orderBy("_row"))
    return named.withColumn("_copy", own).select(
        "_id", "_row", "_copy", "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = materialize(groups(docs, doc_id, text, **options).select("_row", "kept"))
    counts = found.groupBy("_row").agg(F.count_if("kept").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    return without(docs, doc_id, text, counts.select("_row", "_times"), counts.filter("_times < _rows"))


def fingerprint_of(data: bytes, chunk: int = CHUNK, primes=PRIMES, bases=BASES) -> tuple[int, int, int]:
    """The fingerprint of one text, on its own (for tests)."""
    n = h1 = h2 = 0
    for m, a, s, b, t in chunk_hasher(chunk, primes, bases)(np.frombuffer(data, np.uint8)):
        n, h1, h2 = n + m, (h1 * s + a) % primes[0], (h2 * t + b) % primes[1]
    return n, h1, h2


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs).select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
