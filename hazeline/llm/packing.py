"""Packing of whole documents into training sequences: shortest pack first, over the length histogram.

Documents are tokenized once and cut into pieces of at most ``size`` ids. What is packed is the histogram of piece
lengths, which has ``size`` entries at most whatever the number of documents: lengths are placed longest first, each
into the emptiest pattern that has room, and a pattern carries the number of sequences that look like it. Pieces are
then numbered within their length (rank) and a rank maps to sequence and offset by the pattern's slots.

A null text is an empty document, which has the end id alone. Rows that share a ``doc_id`` are packed one by one.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import land, utf8
from hazeline.llm.encoding import worker_encoder

SIZE = 2048
#: Pieces numbered by one task at a time.
RANKED = 100_000
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, size: int) -> DataFrame:
    """One row per piece, without its ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = worker_encoder(tokenizer, spaced), struct.pack("<I", end_id)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for doc_id, ids in zip(doc_ids, encoder.encode_all([x.decode() for x in batch.column(1).to_pylist()]), strict=True):
                ids += tail
                n = len(ids) // 4
                for at in range(0, n, size):
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(pieces, PIECES)


def shortest_pack_first(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns as ((length, times), ...), longest first, each with its number of sequences.

    Every turn of the loop uses up a length or a pattern, so the work depends on ``size`` alone.
    """
    heap: list[tuple[int, int, tuple, int]] = []  # total, order of arrival, pattern, sequences
    arrived = 0

    def push(total: int, pattern: tuple, n: int) -> None:
        nonlocal arrived
        arrived += 1
        heapq.heappush(heap, (total, arrived, pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not heap or heap[0][0] + length > size:
                push(length, ((length, 1),), left)
                break
            total, _, pattern, n = heapq.heappop(heap)
            used = min(n, left)
            if used < n:
                push(total, pattern, n - used)
            same = pattern[-1][0] == length
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if same else (*pattern, (length, 1))
            push(total + length, grown, used)
            left -= used
    return [(pattern, n) for _, _, pattern, n in sorted(heap, key=lambda x: x[1])]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, times, first sequence, offset, in rank order."""
    taken: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            rank = taken.get(length, 0)
            out.setdefault(length, []).append((rank, times, first, offset))
            taken[length] = rank + n * times
            offset += length * times
        first += n
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def ranked(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """Number the pieces of each length from 0: in buckets by hash, shifted by what earlier buckets hold."""
    buckets = max(1, -(-n_pieces // RANKED))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        pieces.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (
        pieces.withColumn("rank", F.row_number().over(inside) - 1)
        .join(base, ["length", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .drop("bucket", "base")
    )


def pack(docs: DataFrame, tokenizer: str, spaced: bool = False, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    A sequence is padded to ``size`` unless its ids are a power of two in number.
    """
    pieces = land(cut(docs, tokenizer, spaced, end_id, size), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    patterns = shortest_pack_first(counts, size)
    table = slots(patterns)
    ends = np.cumsum([n for _, n in patterns])
    totals = np.array([sum(length * times for length, times in p) for p, _ in patterns], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                rows, at = table[int(value)], np.flatnonzero(length == value)
                slot = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                step = rank[at] - slot[:, 0]
                sequence[at] = slot[:, 2] + step // slot[:, 1]
                offset[at] = slot[:, 3] + step % slot[:, 1] * value
            total = totals[np.searchsorted(ends, sequence, side="right")] if len(totals) else sequence
            padded = np.where(total & (total - 1) == 0, total, size)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "start")], batch.column("length").cast(pa.int64()), *[batch.column(c) for c in ("ids_crc32", "doc_tokens")], pa.array(sequence), pa.array(offset), pa.array(padded, pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"],
            )

    return ranked(pieces, sum(counts.values())).mapInArrow(
        place,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long",
    )
