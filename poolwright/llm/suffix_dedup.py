"""Removal of byte strings that occur more than once, by a distributed sort of suffixes.

Every byte that lies in a ``width``-byte string which also starts somewhere else, in
the same text or in another, is removed. All texts are judged as they came in.

1. Anchors (see anchors.py) thin the suffixes out: equal strings have their anchor at
   the same place, so it is enough to sort the suffixes that start at anchors, by
   their first ``gram`` bytes. An anchor stands for a run of string starts; its
   context is all bytes of those strings.
2. Each task sorts its suffixes into runs. A run is front-coded: of each suffix only
   what follows the prefix it shares with the one before is stored; equal suffixes
   are one entry with a count and the smallest and largest context hash.
3. Runs are cut at common bounds and exchanged. A loser tree merges the pieces of a
   part. Losers keep the length of the prefix they share with the suffix that beat
   them; a comparison starts after it, and often the lengths alone decide.
4. A suffix that occurs once repeats nothing. If all its contexts are the same, every
   string of its run is repeated. Otherwise the contexts are compared string by
   string. Results go back to the runs, and from there to the documents.

The volume of the exchanges follows the input: a suffix travels at most once per run,
however often it occurs, and the contexts that have to be compared once per task.
Contexts of one suffix are compared in slices of bounded size; what a slice of several
leaves open is settled by counting the hashes of the strings.

Defined cases: a null text is empty; texts shorter than ``width`` lose nothing; a text
that occurs twice loses all its bytes if it is long enough; rows equal in id and text
count as two texts; other columns ride along; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from poolwright.llm.anchors import BLOCK, _BYTE, _SECOND, anchor_runs, hashes, prefix_sums
from poolwright.llm.common import give_back, parts_for, row_key, small_batches, table
from poolwright.llm.shingles import mix
from poolwright.session import drop, materialize

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    width: int = 200
    gram: int = 32
    run_entries: int = 150_000
    part_bytes: int = 12 << 20  # of text, for each part of the exchange
    least_parts: int = 64
    sample_texts: int = 2_000  # for the bounds of the parts; it only balances them
    slice_contexts: int = 4_096


# --- small codecs ---------------------------------------------------------------------------


def squeeze(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    body = b"".join(raw)
    head = struct.pack(f"<I{len(raw)}I", len(body), *map(len, raw))
    return head + pa.compress(body, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, *types) -> list[np.ndarray]:
    size, *lengths = struct.unpack_from(f"<I{len(types)}I", data)
    body = pa.decompress(data[4 * (len(types) + 1) :], size, codec="zstd", asbytes=True)
    out, at = [], 0
    for n, kind in zip(lengths, types, strict=True):
        out.append(np.frombuffer(body, kind, count=n // np.dtype(kind).itemsize, offset=at))
        at += n
    return out


# --- anchors of texts -----------------------------------------------------------------------


def _runs(data: np.ndarray, valid: np.ndarray | None, s: Settings):
    """lo, hi, anchor, context hash of the runs in a block; ``valid`` marks the string starts."""
    sums = prefix_sums(data)
    anchor = anchor_runs(data, sums, s.width, s.gram)
    at = np.arange(len(anchor)) if valid is None else np.flatnonzero(valid[: len(anchor)])
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    heads = np.r_[0, np.flatnonzero((np.diff(anchor[at]) != 0) | (np.diff(at) != 1)) + 1]
    lo, hi = at[heads], at[np.r_[heads[1:], len(at)] - 1]
    p = anchor[lo]
    # the place of the anchor belongs to the context
    context = mix(hashes(sums, lo, hi - lo + s.width) + (p - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return lo, hi, p, context


def text_runs(raw: np.ndarray, ends: np.ndarray, s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For texts that lie one after the other: (text, lo, hi, anchor, context, gram bytes), places relative to the text."""
    n, i = len(ends) - 1, 0
    view = np.lib.stride_tricks.sliding_window_view
    while i < n:
        j = min(int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1, n)
        if j <= i:  # a text larger than a block, in pieces that overlap by more than a run
            text = raw[ends[i] : ends[i + 1]]
            for start in range(0, len(text) - s.width + 1, BLOCK):
                first = max(0, start - s.width)
                piece = text[first : start + BLOCK + 2 * s.width]
                lo, hi, p, context = _runs(piece, None, s)
                own = (lo + first >= start) & (lo + first < start + BLOCK)
                lo, hi, p, context = lo[own], hi[own], p[own], context[own]
                yield np.full(len(lo), i), lo + first, hi + first, p + first, context, view(piece, s.gram)[p]
            i += 1
            continue
        block = raw[ends[i] : ends[j]]
        if len(block) >= s.width:
            of = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
            left = ends[of + 1] - ends[i] - np.arange(len(block))
            lo, hi, p, context = _runs(block, left >= s.width, s)
            if len(lo):
                base = ends[of[lo]] - ends[i]
                yield of[lo], lo - base, hi - base, p - base, context, view(block, s.gram)[p]
        i = j


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text ends; null is empty."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), ends


# --- sorted, front-coded runs ---------------------------------------------------------------


def sorted_run(grams: np.ndarray, contexts: np.ndarray):
    """Sort and collapse: (distinct grams in order, count, smallest and largest context, entry of each occurrence)."""
    pad = -grams.shape[1] % 8
    words = np.ascontiguousarray(np.pad(grams, ((0, 0), (0, pad)))).view(">u8")
    order = np.lexsort(words.T[::-1])
    rows = grams[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(1)] if len(rows) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    counts = np.diff(np.r_[heads, len(rows)])
    own = contexts[order]
    return rows[heads], counts, np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads), of


def front_coded(rows: np.ndarray, counts: np.ndarray, least: np.ndarray, most: np.ndarray) -> bytes:
    n, width = rows.shape
    shared = np.zeros(n, np.uint8)
    if n > 1:
        shared[1:] = (rows[1:] != rows[:-1]).argmax(1)
    rest = rows[np.arange(width) >= shared[:, None]]
    return squeeze(shared, rest, counts.astype(np.uint32), least, least ^ most)


def decoded(data: bytes, width: int):
    """(shared prefix lengths, suffixes, counts, smallest, largest) of a front-coded block, as lists."""
    shared, rest, counts, least, both = unsqueeze(data, np.uint8, np.uint8, np.uint32, np.uint64, np.uint64)
    suffixes, before, at, raw = [], b"", 0, rest.tobytes()
    lengths = shared.tolist()
    for k in lengths:
        before = before[:k] + raw[at : at + width - k]
        at += width - k
        suffixes.append(before)
    return lengths, suffixes, counts.tolist(), least.tolist(), (least ^ both).tolist()


def merged(blocks: list[tuple[list[int], list[bytes]]], width: int) -> Iterator[tuple[int, int, bool]]:
    """Merge sorted blocks: (block, entry, whether equal to the suffix before), in order.

    A loser tree. ``common[b]`` is the length of the prefix that the head of block b
    shares with the suffix that beat it last (for the winner: with the last one put
    out). Of two heads measured against the same suffix the one that shares more is
    smaller; only equal lengths need a comparison, and that starts after them.
    """
    blocks = [b for b in blocks]
    count = len(blocks)
    size = 1
    while size < count:
        size *= 2
    at = [0] * size
    ends = [len(b[1]) for b in blocks] + [0] * (size - count)
    heads: list[bytes | None] = [b[1][0] if b[1] else None for b in blocks] + [None] * (size - count)
    common = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix is set."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        i, j = common[a], common[b]
        if i != j:
            return (a, b) if i > j else (b, a)
        while i < width and x[i] == y[i]:
            i += 1
        if i == width or x[i] < y[i]:
            common[b] = i
            return a, b
        common[a] = i
        return b, a

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if size > 1 else 0
    first = True
    while heads[best] is not None:
        k = at[best]
        yield best, k, not first and common[best] == width
        first = False
        at[best] = k = k + 1
        if k < ends[best]:
            heads[best], common[best] = blocks[best][1][k], blocks[best][0][k]
        else:
            heads[best] = None
        node = (best + size) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


# --- the steps as Spark jobs ----------------------------------------------------------------

STORED = "kind int, run bigint, part int, data binary, rows array<string>"


def _make_runs(s: Settings, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        number = 0
        held, rows, entries = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, rows, entries
            name = task * (1 << 24) + number
            number += 1
            of, lo, hi, p, contexts = (np.concatenate([h[c] for h in held]) for c in range(5))
            distinct, counts, least, most, entry = sorted_run(np.concatenate([h[5] for h in held]), contexts)
            lead = np.ascontiguousarray(distinct[:, :8]).view(">u8").ravel().astype(np.uint64)
            cuts = np.r_[0, np.searchsorted(lead, bounds, "left"), len(distinct)]
            out = []
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[part], cuts[part + 1]
                out.append((0, part, squeeze(np.array([a], np.int64)) + front_coded(distinct[a:b], counts[a:b], least[a:b], most[a:b]), None))
            out.append((1, None, squeeze(*(x.astype(np.int32) for x in (of, lo, hi, p, entry))), rows))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.int32()),
                    pa.array([name] * len(out), pa.int64()),
                    pa.array([o[1] for o in out], pa.int32()),
                    pa.array([o[2] for o in out], pa.binary()),
                    pa.array([o[3] for o in out], pa.list_(pa.string())),
                ],
                ["kind", "run", "part", "data", "rows"],
            )
            held, rows, entries = [], [], 0
            return batch

        for batch in batches:
            raw, ends = _buffers(batch["_text"])
            names = batch["_row"].to_pylist()
            place: dict[int, int] = {}
            for of, lo, hi, p, contexts, grams in text_runs(raw, ends, s):
                if not len(lo):
                    continue
                own = np.unique(of)
                for t in own.tolist():
                    if t not in place:
                        place[t] = len(rows)
                        rows.append(names[t])
                local = np.array([place[t] for t in own.tolist()])[np.searchsorted(own, of)]
                held.append((local, lo, hi, p, contexts, np.ascontiguousarray(grams)))
                entries += len(lo)
                if entries >= s.run_entries:
                    yield flush()
                    place = {}
        if held:
            yield flush()
        give_back()

    return run


_HEAD = len(squeeze(np.array([0], np.int64)))


def _merge_part(width: int):
    def run(blocks: pa.Table) -> pa.Table:
        names, starts, parts = [], [], []
        for name, data in zip(blocks["run"].to_pylist(), blocks["data"].to_pylist(), strict=True):
            (first,) = unsqueeze(data[:_HEAD], np.int64)
            names.append(name)
            starts.append(int(first[0]))
            parts.append(decoded(data[_HEAD:], width))
        found: dict[int, tuple[list[int], list[bool]]] = {}
        group: list[tuple[int, int]] = []
        total, least, most = 0, 0, 0

        def close():
            if total > 1:
                many = least != most
                for b, k in group:
                    entries, flags = found.setdefault(b, ([], []))
                    entries.append(starts[b] + k)
                    flags.append(many)

        for b, k, same in merged([(p[0], p[1]) for p in parts], width):
            _, _, counts, low, high = parts[b]
            if same:
                total += counts[k]
                least, most = min(least, low[k]), max(most, high[k])
                group.append((b, k))
            else:
                close()
                total, least, most = counts[k], low[k], high[k]
                group = [(b, k)]
        close()
        return pa.table(
            {
                "run": pa.array([names[b] for b in found], pa.int64()),
                "found": pa.array([squeeze(np.array(e, np.int32), np.array(f, np.uint8)) for e, f in found.values()], pa.binary()),
            }
        )

    return run


FLAGGED = "_row string, _block int, _lo array<int>, _hi array<int>, _p array<int>, _many array<boolean>"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs with their results to documents: the string runs that may be repeated.

    A text larger than a block may lie in several runs, but each of its blocks lies in one.
    So a row holds one block of a text, and rows of copies of a text are equal.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            of, lo, hi, p, entry = unsqueeze(batch["data"][i].as_py(), *[np.int32] * 5)
            state = np.zeros(int(entry.max()) + 1, np.uint8)
            for piece in batch["found"][i].as_py():
                entries, many = unsqueeze(piece, np.int32, np.uint8)
                state[entries] = 1 + many
            hit = np.flatnonzero(state[entry])
            hit = hit[np.lexsort((lo[hit], of[hit]))]
            own, block = of[hit], lo[hit] // BLOCK
            new = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
            heads = np.flatnonzero(np.r_[True, new]) if len(own) else np.zeros(0, int)
            ends = pa.array(np.r_[heads, len(own)].astype(np.int32))
            rows = batch["rows"][i].values.take(pa.array(own[heads]))
            many = pa.array(state[entry[hit]] == 2)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[hit])) for x in (lo, hi, p)] + [pa.ListArray.from_arrays(ends, many)]
            yield pa.RecordBatch.from_arrays([rows, pa.array(block[heads].astype(np.int32)), *lists], ["_row", "_block", "_lo", "_hi", "_p", "_many"])


def _whole(flagged: DataFrame) -> DataFrame:
    """The blocks of each text side by side. Copies add nothing, so a row is no larger than its text needs."""
    lists = ["_lo", "_hi", "_p", "_many"]
    blocks = flagged.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("_block", *lists))).alias("_blocks"))
    return blocks.select("_row", F.monotonically_increasing_id().alias("_d"), *[F.flatten(F.col("_blocks")[c]).alias(c) for c in lists])


CONTEXTS = "g1 bigint, g2 bigint, c1 bigint, c2 bigint, times bigint, context binary"
PLACES = "_d bigint, _at int, c1 bigint, c2 bigint"
_PAIR = (_BYTE, _SECOND)


def _named(sums: list[np.ndarray], at: np.ndarray, length: np.ndarray | int, lead: np.ndarray | int = 0) -> list[np.ndarray]:
    """128 bits that name pieces, and the place of the anchor in them."""
    extra = (np.asarray(lead, np.uint64) * _U(1_000_003)) + np.asarray(length, np.uint64)
    return [mix(hashes(x, at, length) + extra).view(np.int64) for x in sums]


def _ambiguous(batch: pa.RecordBatch, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The contexts that have to be compared, block by block: (row, lo in its text, bytes of the block, start, length, lead, hash sums)."""
    raw, ends = _buffers(batch["_text"])
    starts = [batch[c].offsets.to_numpy() for c in ("_lo",)][0]
    lo, hi, p = (batch[c].values.to_numpy() for c in ("_lo", "_hi", "_p"))
    many = batch["_many"].values.to_numpy(zero_copy_only=False)
    count = np.diff(starts) * batch["_lo"].is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), count)
    if not len(row):
        return
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[:-1], count)
    keep = many[place]
    row, place = row[keep], place[keep]
    lo, hi, p = lo[place].astype(np.int64), hi[place].astype(np.int64), p[place].astype(np.int64)
    first, last = ends[row] + lo, ends[row] + hi + s.width
    i = 0
    while i < len(row):  # contexts of a batch lie in order; a block holds those that end within it
        j = max(i + 1, int(np.searchsorted(last, first[i] + BLOCK, "right")))
        block = raw[first[i] : last[j - 1]]
        yield row[i:j], lo[i:j], block, first[i:j] - first[i], last[i:j] - first[i:j], p[i:j] - lo[i:j], [prefix_sums(block, t) for t in _PAIR]
        i = j


def _contexts(s: Settings):
    """Contexts to compare, equal ones of a task combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def flush():
            keys, values = list(held), list(held.values())
            columns = [[v[0] for v in values], [v[1] for v in values], [k[0] for k in keys], [k[1] for k in keys], [v[2] for v in values]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns] + [pa.array([v[3] for v in values], pa.binary())],
                ["g1", "g2", "c1", "c2", "times", "context"],
            )

        for batch in batches:
            for _, _, block, at, length, lead, sums in _ambiguous(batch, s):
                c1, c2 = _named(sums, at, length, lead)
                g1, g2 = _named(sums, at + lead, s.gram)
                _, once, times = np.unique(c1, return_index=True, return_counts=True)
                for k, n in zip(once.tolist(), times.tolist(), strict=True):
                    key = (int(c1[k]), int(c2[k]))
                    got = held.get(key)
                    if got is None:
                        held[key] = [int(g1[k]), int(g2[k]), n, block[at[k] : at[k] + length[k]].tobytes()]
                    else:
                        got[2] += n
                if len(held) >= 30_000:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    return run


def _places(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["_d"].to_numpy(zero_copy_only=False)
            for row, lo, _, at, length, lead, sums in _ambiguous(batch, s):
                c1, c2 = _named(sums, at, length, lead)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row].astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(c1), pa.array(c2)], ["_d", "_at", "c1", "c2"]
                )

    return run


RESOLVED = "c1 bigint, c2 bigint, hits array<int>, open array<struct<at:int,w1:bigint,w2:bigint>>"


def _resolve(s: Settings):
    """Which strings of each context occur in another one (or in an equal one elsewhere).

    Rows come sorted by suffix and context. A slice holds at most ``slice_contexts``
    contexts of one suffix; if the suffix has several slices, strings that are alone in
    one stay open, and one of each that is not speaks to the other slices.
    """

    def settle(rows: list, closed: list[bool]) -> list[tuple]:
        """rows: c1, c2, times, bytes; closed: whether all contexts of the suffix are here."""
        numbers = np.array([len(r[3]) - s.width + 1 for r in rows])
        names: list[list[np.ndarray]] = [[], []]
        i = 0
        while i < len(rows):  # contexts side by side, as many as hash sums reach
            j, size = i, 0
            while j < len(rows) and (j == i or size + len(rows[j][3]) <= BLOCK):
                size += len(rows[j][3])
                j += 1
            block = np.frombuffer(b"".join(r[3] for r in rows[i:j]), np.uint8)
            n = numbers[i:j]
            heads = np.cumsum([0, *(len(r[3]) for r in rows[i : j - 1])])
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(heads, n)
            for out, t in zip(names, _PAIR, strict=True):
                out.append(hashes(prefix_sums(block, t), at, s.width))
            i = j
        first, second = (np.concatenate(x).view(np.int64) for x in names)
        # Strings of different suffixes differ, so they need not be kept apart.
        _, once, inverse = np.unique(first, return_index=True, return_inverse=True)
        often = np.bincount(inverse, weights=np.repeat([r[2] for r in rows], numbers))[inverse] > 1
        speaks = ~often  # to the other slices; of strings that are settled here, one speaks
        speaks[once] = True
        speaks &= ~np.repeat(closed, numbers)
        heads = np.cumsum([0, *numbers])
        out = []
        for i in np.flatnonzero(np.add.reduceat(often | speaks, heads[:-1])).tolist():
            a, b = heads[i], heads[i + 1]
            alone = np.flatnonzero(speaks[a:b]).tolist()
            opened = [{"at": k, "w1": int(first[a + k]), "w2": int(second[a + k])} for k in alone]
            out.append((rows[i][0], rows[i][1], np.flatnonzero(often[a:b]).tolist(), opened))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffix, rows, closed, begin, out = None, [], [], 0, []

        def emit():
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct([("at", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], ["c1", "c2", "hits", "open"])

        for batch in batches:
            for g1, g2, c1, c2, times, piece in zip(*(batch[c].to_pylist() for c in ("g1", "g2", "c1", "c2", "times", "context")), strict=True):
                if (g1, g2) != suffix:
                    suffix, begin, sliced = (g1, g2), len(rows), False
                    if len(rows) >= s.slice_contexts:  # suffixes that are complete go together
                        out += settle(rows, closed)
                        rows, closed, begin = [], [], 0
                elif rows and rows[-1][0] == c1 and rows[-1][1] == c2:
                    rows[-1][2] += times
                    continue
                elif len(rows) - begin >= s.slice_contexts:
                    sliced = True
                    closed[begin:] = [False] * (len(rows) - begin)
                    out += settle(rows, closed)
                    rows, closed, begin = [], [], 0
                rows.append([c1, c2, times, piece])
                closed.append(not sliced)
            if len(out) > 5_000:
                yield emit()
                out = []
        if rows:
            out += settle(rows, closed)
        if out:
            yield emit()

    return run


_CLEANED = T.StructType(
    [
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _remove(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = _buffers(batch["_text"])
            removed, spans, kept = [], [], []
            for i in range(batch.num_rows):
                text = raw[ends[i] : ends[i + 1]]
                step = np.zeros(len(text) + 1, np.int32)
                if batch["_lo"][i].is_valid:
                    sure = ~batch["_many"][i].values.to_numpy(zero_copy_only=False)
                    np.add.at(step, batch["_lo"][i].values.to_numpy()[sure], 1)
                    np.add.at(step, batch["_hi"][i].values.to_numpy()[sure] + s.width, -1)
                for one in batch["_hits"][i].as_py() or ():
                    at = one["_at"] + np.array(one["hits"], np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + s.width, -1)
                gone = np.cumsum(step[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0])).tolist()
                removed.append(int(gone.sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(text[~gone].tobytes() if removed[-1] else text.tobytes())
            extra = [pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["_in"], batch["_text"], *extra], ["_in", "_text", "n_removed", "spans", "kept"])

    return run


def _bounds(texts: DataFrame, s: Settings) -> np.ndarray:
    """First bytes of suffixes that cut them into parts of about the same size."""
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    parts = parts_for(size, s.part_bytes, s.least_parts)
    share = min(1.0, s.sample_texts / max(1, n))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = _buffers(batch["_text"])
            for *_, grams in text_runs(raw, ends, s):
                few = grams[:: max(1, len(grams) // 20_000)]
                lead = np.ascontiguousarray(few[:, :8]).view(">u8").ravel().astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((lead >> _U(1)).astype(np.int64))], ["lead"])

    few = texts.filter(F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = few.select("_text").mapInArrow(leads, "lead bigint").toArrow()["lead"].to_numpy()
    if not len(found):
        return np.empty(0, np.uint64)
    return np.unique(np.quantile(found, np.arange(1, parts) / parts, method="lower").astype(np.uint64) << _U(1))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with n_removed, spans (removed byte ranges) and kept (the bytes that remain) as _n_removed, _spans, _kept."""
    s = settings
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    rest = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    texts = docs.select(rest.alias("_in"), row_key(doc_id, text).alias("_row"), F.col(text).alias("_text"))
    bounds = _bounds(texts.select("_row", "_text"), s)
    stored = materialize(texts.select("_row", "_text").mapInArrow(_make_runs(s, bounds), STORED))
    blocks = stored.filter("kind = 0").select("run", "part", "data")
    parts = blocks.groupBy("part").applyInArrow(_merge_part(s.gram), "run bigint, found binary")
    results = parts.groupBy("run").agg(F.collect_list("found").alias("found"))  # no more entries than the run has
    runs = stored.filter("kind = 1").select("run", "data", "rows").hint("merge").join(results, "run")
    # One row and one _d for each text, decided here once: whatever reads them later reads the same.
    flagged = materialize(_whole(runs.mapInArrow(_spread, FLAGGED)))
    drop(stored)

    # One plan from here on. The comparison of contexts, their places and the removal read ``met`` with
    # the same columns, so Spark shuffles the texts once and uses that exchange three times.
    met = texts.hint("merge").join(flagged, "_row", "left").select("_in", "_row", "_text", "_d", "_lo", "_hi", "_p", "_many")
    suffix = ["g1", "g2"]
    sorted_ = met.mapInArrow(_contexts(s), CONTEXTS).repartition(*suffix).sortWithinPartitions(*suffix, "c1", "c2")
    resolved = sorted_.mapInArrow(_resolve(s), RESOLVED)
    # Settled strings count as they are; open ones if their hash comes twice.
    sure = F.struct(F.lit(True).alias("sure"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("hits").alias("hits"))
    asked = F.transform("open", lambda o: F.struct(F.lit(False).alias("sure"), o["w1"].alias("k1"), o["w2"].alias("k2"), F.array(o["at"]).alias("hits")))
    rows = resolved.select("c1", "c2", F.explode(F.concat(F.array(sure), asked)).alias("_o")).select("c1", "c2", "_o.*")
    twice = F.count(F.lit(1)).over(Window.partitionBy("sure", "k1", "k2")) > 1
    hits = rows.withColumn("_twice", twice).filter("(sure or _twice) and size(hits) > 0").select("c1", "c2", "hits")
    places = met.mapInArrow(_places(s), PLACES)
    per_text = (
        places.hint("merge").join(hits.hint("merge"), ["c1", "c2"])
        .groupBy("_d").agg(F.collect_list(F.struct("_at", "hits")).alias("_hits"))
    )
    # back to the key of the texts, so that they stay where they are
    per_row = flagged.select("_row", "_d").hint("merge").join(per_text.hint("merge"), "_d").select("_row", "_hits")
    ready = met.join(per_row.hint("merge"), "_row", "left").select("_in", "_text", "_d", "_lo", "_hi", "_p", "_many", "_hits")
    schema = T.StructType([texts.schema["_in"], T.StructField("_text", T.StringType()), *_CLEANED.fields])
    done = ready.mapInArrow(_remove(s), schema)
    own = {c: F.col("_in").getField(f"c{k}") for k, c in enumerate(others)} | {text: F.col("_text")}
    return done.select(
        *[own[c].alias(c) for c in docs.columns if c not in ("_n_removed", "_spans", "_kept")],
        F.col("n_removed").alias("_n_removed"), F.col("spans").alias("_spans"), F.col("kept").alias("_kept"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.col("_n_removed").alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )
