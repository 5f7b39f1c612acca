"""Exact deduplication of arriving documents against an immutable snapshot, by static binary-fuse filters.

A snapshot is summarised once: its distinct digests are dealt into buckets by hash, and each bucket gets a 3-wise
binary-fuse filter with 16-bit fingerprints (about 2.3 bytes a digest). Arriving documents are grouped by digest on
their own (duplicates within the batch), one digest each is screened by its bucket's filter, and the few positives
meet the snapshot's exact digests, where representative texts are compared byte by byte. False positives of a filter
fall out there; a filter has no false negatives.

Texts are equal when identical; null counts as empty. Of equal texts the row with the largest ``doc_id`` stays
(a null id is smaller than any; a group without ids keeps all its rows). Rows that repeat both id and text are
copies of one document: each is reported as kept, and ``drop_copies`` leaves one of them. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import land, whole_row

#: Digests in one bucket, and so in one filter.
BUCKET = 50_000
FINGERPRINT = np.uint16


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over keys and a seed."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class FuseFilter:
    """Static 3-wise binary-fuse filter over 64-bit keys: overlapping segments of a power of two in length."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots in consecutive segments, and the fingerprint of each key."""
        h = _mix(keys, seed)
        first = (h >> np.uint64(32)) * np.uint64(count * segment) >> np.uint64(32)
        low = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ (h >> np.uint64(18) & low)
        third = (first + np.uint64(2 * segment)) ^ (h & low)
        return np.stack([first, second, third]).astype(np.int64), (h ^ h >> np.uint64(32)).astype(FINGERPRINT)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, int(np.log(n) / np.log(3.33) + 2.25))
        size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)))
        count = max(1, -(-size // segment) - 2)
        for seed in range(1, 200):
            slots, prints = cls.places(keys, seed, segment, count)
            if (order := cls._peel(slots, (count + 2) * segment)) is not None:
                table = np.zeros((count + 2) * segment, FINGERPRINT)
                for some, own in reversed(order):  # keys of one round own distinct slots none of them reads
                    a, b, c = slots[:, some]
                    table[own] = prints[some] ^ table[a] ^ table[b] ^ table[c]
                return cls(seed, segment, count, table)
        raise ValueError("no seed leads to a filter")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, own slots): a key goes once a slot is its alone; None if some never are."""
        n = slots.shape[1]
        held = np.bincount(slots.ravel(), minlength=size)
        sums = np.zeros(size, np.int64)  # of the numbers of the keys in a slot: the key itself where there is one
        np.add.at(sums, slots.ravel(), np.tile(np.arange(n), 3))
        order, gone = [], 0
        ready = np.flatnonzero(held == 1)
        while len(ready):
            some, at = np.unique(sums[ready], return_index=True)
            own = ready[at]
            order.append((some, own))
            gone += len(some)
            touched = slots[:, some].ravel()
            np.subtract.at(held, touched, 1)
            np.subtract.at(sums, touched, np.tile(some, 3))
            touched = np.unique(touched)
            ready = touched[held[touched] == 1]
        return order if gone == n else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self.places(keys, self.seed, self.segment, self.count)
        a, b, c = slots
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], "<i8").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        seed, segment, count = np.frombuffer(data, "<i8", 3).tolist()
        return cls(seed, segment, count, np.frombuffer(data, FINGERPRINT, offset=24))


def digests(docs: DataFrame, is_new) -> DataFrame:
    """doc_id, whether it arrives, text_sha256 and a 64-bit key of it."""
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    return docs.select("doc_id", F.coalesce(is_new, F.lit(True)).alias("new"), digest.alias("text_sha256")).withColumn(
        "key", F.xxhash64("text_sha256")
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest, combined before the shuffle however large a group is."""
    return rows.groupBy("text_sha256", "key").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("n"))


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) over the snapshot's groups."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"bucket": pdf["bucket"].iloc[:1], "filter": [FuseFilter.build(pdf["key"].to_numpy()).to_bytes()]}
        )

    return (
        snapshot.select("key", F.pmod("key", F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(build, "bucket long, filter binary")
    )


def screen(arriving: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Groups of the arriving batch whose digest the snapshot may hold."""
    columns = arriving.columns

    def keep(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(held):
            return rows.iloc[:0][columns]
        return rows[FuseFilter.from_bytes(held["filter"].iloc[0]).contains(rows["key"].to_numpy())][columns]

    return (
        arriving.withColumn("bucket", F.pmod("key", F.lit(buckets)))
        .groupBy("bucket")
        .cogroup(filters.groupBy("bucket"))
        .applyInPandas(keep, arriving.schema)
    )


def find_copies(docs: DataFrame, is_new) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; ``is_new`` tells the arriving rows."""
    rows = land(digests(docs, is_new), "digests")
    snapshot = land(groups(rows.where("not new")), "snapshot")
    arriving = groups(rows.where("new"))
    buckets = max(1, -(-snapshot.count() // BUCKET))
    positives = land(screen(arriving, build_filters(snapshot, buckets), buckets), "positives")
    pairs = land(
        positives.alias("a").join(snapshot.alias("s"), "text_sha256")
        .select("text_sha256", F.col("a.last_id").alias("new_id"), F.col("s.last_id").alias("old_id")), "pairs"
    )
    same = _same_bytes(docs, pairs)
    # A digest that both sides hold is one group where the bytes agree, else (a collision) two.
    old = snapshot.select("text_sha256", F.lit(False).alias("new"), "last_id", "n")
    both = old.unionByName(arriving.select("text_sha256", F.lit(True).alias("new"), "last_id", "n"))
    sizes = (
        both.join(same.withColumn("same", F.lit(True)), "text_sha256", "left")
        .withColumn("side", F.when(F.col("same"), F.lit(0)).otherwise(F.col("new").cast("int") + 1))
        .withColumn("keep_id", F.max("last_id").over(Window.partitionBy("text_sha256", "side")))
        .withColumn("group_size", F.sum("n").over(Window.partitionBy("text_sha256", "side")))
        .select("text_sha256", "new", "keep_id", "group_size")
    )
    return rows.join(sizes, ["text_sha256", "new"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Digests whose arriving and snapshot representatives have the same bytes."""
    wanted = pairs.select("text_sha256", F.explode(F.array("new_id", "old_id")).alias("doc_id")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(
        wanted.withColumnRenamed("doc_id", "wanted_id").hint("merge"), F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    )
    # Rows that share an id may hold other texts: only those with the wanted digest count.
    return (
        found.where(F.sha2("text", 256) == F.col("text_sha256"))
        .groupBy("text_sha256")
        .agg((F.min("text") == F.max("text")).alias("equal"))
        .where("equal")
        .select("text_sha256")
    )


def newer_half(docs: DataFrame):
    """The condition of the registered query: ids above the middle of their range arrive on top of the rest."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(True) if low is None else F.col("doc_id") > (low + high) // 2


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each text."""
    kept = find_copies(docs, newer_half(docs)).where("kept").select("doc_id", "text_sha256").distinct()
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = docs.select(whole_row(docs), "doc_id", sha.alias("text_sha256"))
    once = Window.partitionBy("l.doc_id", "l.text_sha256").orderBy("l.doc_id")
    return (
        rows.alias("l")
        .join(kept.hint("merge").alias("r"), F.expr("l.doc_id <=> r.doc_id and l.text_sha256 = r.text_sha256"))
        .withColumn("n", F.row_number().over(once))
        .where("n = 1")
        .select("row.*")
    )
