"""Token ids as directly addressable codes, written and read by Spark.

Each id is split into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that has one,
and a bitmap with a 1 where a further chunk follows. The place of an id's next chunk is the number of ones before
it, which a directory of counts (one per 512 bits) gives in constant time, so any id of a shard can be read
without decoding what stands before it.

A shard image is: magic, number of levels, ids per level (u64 each), then per level the chunks, the bitmap and the
directory. Images are rows of a Parquet data set, so Spark's commit protocol keeps a data set whole when executors
are lost; a shard holds whole documents in ascending ``doc_id`` order and closes at ``shard_tokens`` ids.

Pages hold images as they are, uncompressed; :func:`token_at` reads one id from its shard.

Null ``doc_id`` sorts first; rows that share one are ordered by their stored ids. Null and empty texts have the
end id alone. An empty table gives an empty data set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.encoding import worker_encoder

MAGIC = b"DAC1"
CHUNK, BLOCK = 8, 512
SHARD_TOKENS = 1 << 21
SHARDS = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()),
        ("first_id", pa.int64()), ("last_id", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("image", pa.binary()),
    ]
)
SHARDS_SQL = "part int, seq int, before long, n_tokens long, first_id long, last_id long, doc_ids array<long>, lengths array<long>, image binary"


def encode_levels(ids: np.ndarray) -> bytes:
    """Image of a shard."""
    ids, levels = ids.astype(np.uint32), []
    while True:
        rest = ids >> CHUNK
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ends = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else more
        directory = np.concatenate([[0], np.cumsum(ends)]).astype("<u8")
        levels.append((len(ids), (ids & 255).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes()))
        if not more.any():
            break
        ids = rest[more]
    head = MAGIC + struct.pack(f"<Q{len(levels)}Q", len(levels), *[n for n, _ in levels])
    return head + b"".join(body for _, body in levels)


class Image:
    """Random access to a shard image."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack_from("<Q", data, 4)
        sizes = struct.unpack_from(f"<{n}Q", data, 12)
        at, self.levels = 12 + 8 * n, []
        for size in sizes:
            chunks = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, -(-size // 8), at + size)
            at += size + len(bits)
            directory = np.frombuffer(data, "<u8", -(-size // BLOCK) + 1, at)
            at += 8 * len(directory)
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK
        tail = np.unpackbits(bits[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(directory[block]) + int(tail.sum())

    def token(self, i: int) -> int:
        """The id at place i; no other id is decoded."""
        value = shift = 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self.rank(bits, directory, i), shift + CHUNK
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids of places start to end, read from there alone."""
        out = np.zeros(end - start, np.uint32)
        places, shift = np.arange(end - start), 0
        for chunks, bits, directory in self.levels:
            if start == end:
                break
            out[places] |= chunks[start:end].astype(np.uint32) << np.uint32(shift)
            low = start // 8
            more = np.unpackbits(bits[low : -(-end // 8)], bitorder="little")[start - 8 * low : end - 8 * low] > 0
            places, shift = places[more], shift + CHUNK
            if not len(places):
                break
            start = self.rank(bits, directory, start)
            end = start + len(places)
        return out


def encode_documents(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, borders: list[float]) -> DataFrame:
    """(part, doc_id, width, codes): ids as integers of width bytes, and the range of ``borders`` the doc_id is in."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, spaced, narrow=True)
        tail = encoder.packed([end_id])
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                codes = [ids + tail for ids in encoder.encode_all(some.column(1).to_pylist())]
                part = np.searchsorted(borders, some.column(0).fill_null(-(1 << 63)).to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), some.column(0), pa.array([encoder.width] * len(some), pa.int32()), pa.array(codes, pa.binary())],
                    names=["part", "doc_id", "width", "codes"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(encode, "part int, doc_id long, width int, codes binary")


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, spaced: bool = True, end_id: int = 0, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Write all documents' ids in ascending doc_id order; one pass over the texts, one range shuffle of codes."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = -1, 0, 0
        doc_ids, pieces, total = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            row = [[part], [seq], [before], [len(ids)], doc_ids[:1], doc_ids[-1:], [doc_ids], [[len(p) for p in pieces]], [encode_levels(ids)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(row, SHARDS, strict=True)], schema=SHARDS
            )

        for batch in batches:
            for own, doc_id, width, codes in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                ids = np.frombuffer(codes, f"<u{width}")
                if pieces and (own != part or total + len(ids) > shard_tokens):
                    yield close()
                    before, seq = before + total, seq + 1
                    doc_ids, pieces, total = [], [], 0
                if own != part:
                    part, seq, before = own, 0, 0
                doc_ids.append(doc_id)
                pieces.append(ids)
                total += len(ids)
        if pieces:
            yield close()

    # Range borders come from the ids alone, so texts are tokenized once, on the way to the range shuffle. Each range is
    # one partition of its own; a hash of its number would leave some partitions empty and fill others twice.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    coded = encode_documents(docs, tokenizer, spaced, end_id, sorted(set(borders)))
    ordered = coded.repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "codes")
    shards_ = ordered.select("part", "doc_id", "width", "codes").mapInArrow(shards, SHARDS_SQL)
    shards_.write.option("compression", "uncompressed").parquet(path)


def token_at(spark, path: str, doc_id: int, i: int) -> int:
    """Id ``i`` of a document, read from its shard alone; of rows that share the doc_id, the first."""
    shards = spark.read.schema(SHARDS_SQL).parquet(path).where(f"first_id <= {doc_id} AND last_id >= {doc_id}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, doc_ids, lengths, image in zip(*[batch.column(c) for c in range(5)], strict=True):
                own = [x.as_py() for x in doc_ids.values]
                if doc_id in own and 0 <= i < lengths.as_py()[own.index(doc_id)]:
                    start = sum(lengths.as_py()[: own.index(doc_id)])
                    row = [[part.as_py()], [seq.as_py()], [Image(image.as_py()).token(start + i)]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in row], names=["part", "seq", "token"])

    found = shards.select("part", "seq", "doc_ids", "lengths", "image").mapInArrow(read, "part long, seq long, token long")
    first = found.orderBy("part", "seq").first()
    if first is None:
        raise LookupError(f"no id {i} in document {doc_id}")
    return first["token"]


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards."""
    shards = spark.read.schema(SHARDS_SQL).parquet(path)
    # One row per range partition, and the writer sets their number: never more than a few thousand.
    bases, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        bases[r["part"]], total = total, total + r["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, doc_ids, lengths, image in zip(*[batch.column(i) for i in range(5)], strict=True):
                image, lengths = Image(image.as_py()), np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(lengths)
                crcs = [
                    zlib.crc32(image.tokens(e - n, e).astype("<u4").tobytes())
                    for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(bases[part.as_py()] + before.as_py() + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "before", "doc_ids", "lengths", "image").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
