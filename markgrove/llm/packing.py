"""Best-fit packing of tokenised documents into fixed-length sequences, by large-item matching.

Three passes. Documents are tokenised and cut (the one expensive pass; its narrow
result is written once). The histogram of piece lengths, at most CAPACITY rows
whatever the corpus, is packed on the driver by runs of equal lengths: pieces
above a third of the capacity pair at most two a sequence, the largest with the
largest that still fits; smaller ones go, longest first, to the tightest gap that
holds them. The plan says, for each length, which ranks go to which sequence and
offset; it is bounded like the histogram. Then every piece gets its rank among
those of its length, in blocks, and looks its place up.

Defined results: a null text counts as empty, so its document is the end id
alone; only documents of more than the capacity are cut, the first piece takes
the remainder; repeated rows are packed each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BATCH_BYTES, pair_merger
from .common import number_within, settle, slices

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked together, about.
BLOCK_ROWS = 20_000
#: Pieces of a length up to this many are one block, and a few times as many a few.
SMALL_ROWS = 250


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one with the remainder."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = pair_merger(path)
        for batch in (s for b in batches for s in slices(b, 1, BATCH_BYTES)):
            owner, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(merger.encode([t.as_py() or "" for t in batch.column(1)])):
                packed = ids + END_ID.to_bytes(4, "little")
                for k, (s, n) in enumerate(cut(len(packed) // 4, capacity)):
                    owner.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(packed[4 * s : 4 * (s + n)]))
            keys = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[key, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    return rows.mapInArrow(run, f"`{key}` long, piece int, start long, length long, ids_crc32 long")


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of like sequences as (number of sequences, [(length, copies), ...]) that hold the histogram's pieces exactly."""
    left = {n: c for n, c in histogram.items() if c}
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    open_gaps: list[int] = []

    def put(count: int, gap: int, content: list[tuple[int, int]]) -> None:
        if count:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((count, content))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        mate = large[at] if at >= 0 else None
        if mate is None:
            put(left[n], capacity - n, [(n, 1)])
            left[n] = 0
        elif mate == n:
            put(left[n] // 2, capacity - 2 * n, [(n, 2)])
            left[n] %= 2
            if left[n]:  # the odd one takes the next shorter
                other = large[at - 1] if at else None
                put(1, capacity - n - (other or 0), [(n, 1)] + ([(other, 1)] if other else []))
                left[n] = 0
                if other:
                    left[other] -= 1
                    if not left[other]:
                        large.remove(other)
        else:
            k = min(left[n], left[mate])
            put(k, capacity - n - mate, [(n, 1), (mate, 1)])
            left[n] -= k
            left[mate] -= k
            if not left[mate]:
                large.remove(mate)
        if not left[n]:
            large.remove(n)

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect_left(open_gaps, n)
            if at == len(open_gaps):
                put(-(-count // (capacity // n)), capacity, [])  # as many new sequences as the rest needs
                at = bisect_left(open_gaps, n)
            gap = open_gaps[at]
            bins, content = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            fit = gap // n  # best fit goes on filling the sequence it began
            full = min(bins, count // fit)
            put(full, gap - fit * n, [*content, (n, fit)])
            count -= full * fit
            bins -= full
            if bins and count:
                put(1, gap - count * n, [*content, (n, count)])
                count, bins = 0, bins - 1
            put(bins, gap, content)
    return [g for gap in open_gaps for g in gaps[gap]]


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): key, copies a sequence, first sequence, first offset."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, content in plan:
        offset = 0
        for n, copies in content:
            at = rank.get(n, 0)
            rows.append(((n << 48) + at, copies, sequence, offset))
            rank[n] = at + count * copies
            offset += n * copies
        sequence += count
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = settle(tokenised_pieces(docs, path, capacity, key, text), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    first_key, copies, first_sequence, first_offset = _places(plan_sequences(histogram, capacity))
    blocks = docs.sparkSession.createDataFrame([(n, 4 * (count // BLOCK_ROWS) + min(4, count // SMALL_ROWS + 1)) for n, count in histogram.items()], "_length long, _blocks long")
    pieces = pieces.join(F.broadcast(blocks), F.col("length") == F.col("_length")).drop("_length")
    ranked = number_within(pieces, "length", [key, "piece", "ids_crc32", "start"], F.col("_blocks"), "nth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(first_key, (n << 48) + rank, side="right") - 1
            inside = rank - (first_key[at] - (n << 48))
            sequence = first_sequence[at] + inside // copies[at]
            offset = first_offset[at] + inside % copies[at] * n
            columns = [batch.column(i) for i in range(5)] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = [key, "piece", "start", "length", "ids_crc32", "nth"]
    return ranked.select(*columns).mapInArrow(place, f"`{key}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long")
