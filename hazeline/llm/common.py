"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.session import shared_folder

#: One byte per byte: A-Z to a-z, other ASCII that isn't a letter or digit to a space, all else as it is.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: A-Z to a-z, the white space tab to carriage return to a space, all else as it is.
SPACE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def land(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps don't compute it again.

    The files stay as long as the session's checkpoint folder does; a lost executor costs nothing but the
    tasks it was running.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that columns of any name can travel beside a step's own; ``select("row.*")`` undoes it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


#: Words of one step of hash_words, in bytes; bounds its working memory.
PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << n.bit_length()  # functions travel by value, so what the driver needs should stay small
        for k in (_ODD, pow(_ODD, -1, 1 << 64)):
            factors = np.full(size, k, np.uint64)
            factors[0] = 1
            _POWERS.append(np.multiply.accumulate(factors))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def hash_words(line: bytes) -> np.ndarray:
    """A 64-bit hash of each word of words joined by single spaces; the same in every process."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    out, at = [], 0
    while at < len(line):
        end = len(line) if at + PIECE >= len(line) else line.find(b" ", at + PIECE)
        end = len(line) if end < 0 else end
        letters = np.frombuffer(line, np.uint8, end - at, at)
        power, inverse = _powers(len(letters) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(table[letters] * power[: len(letters)], dtype=np.uint64)])
            gaps = np.flatnonzero(letters == 32)
            starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(letters)]])
            out.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
        at = end + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def hash_runs(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words, by its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * np.uint64(_ODD) + words[i : i + n]
    return mix(total)


class Chunk:
    """Texts whose words are hashed together: words of text i are ``words[first[i] : first[i] + count[i]]``."""

    def __init__(self, texts: list[bytes], table: bytes):
        split = [t.translate(table).split() for t in texts]
        self.count = np.array([len(w) for w in split], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.words = hash_words(b" ".join([b" ".join(w) for w in split if w]))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text number and first word of every run of k words inside one text."""
        n = np.maximum(self.count - k + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return hash_runs(self.words, k)[self.first[text] + place], text, place


def chunks(batch: pa.RecordBatch, column: str, size: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, some at a time: the number of the first and their bytes."""
    start, held, some = 0, 0, []
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or b""
        some.append(text)
        held += len(text)
        if held >= size:
            yield start, some
            start, held, some = i + 1, 0, []
    if some:
        yield start, some
