"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each whole text.

Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower case. An item's windows are its runs of 13
words (all its words, where it has fewer); the automaton holds each distinct window between spaces and every text is
scanned once in the same form. A document word inside any occurrence of a window is hit; hits are mapped back to
character offsets of the original text.

The items are collected behind a size check: beyond ``PART_CHARS`` characters of items they are dealt into several
automata by the hash of their id, each with a scan of its own, and hits are united by document word, so no worker
holds more than one automaton at a time. Null texts have no words; items without words or without an id are left
out; items that share an id count once. A text without words has no hits. Rows that share a ``doc_id`` stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import WORD_BYTES, utf8, whole_row

WINDOW = 13
#: Characters of items in one automaton: about 1 GB of nodes at worst.
PART_CHARS = 4_000_000
#: A document is contaminated from this share of its words on: one in SHARE.
SHARE = 20
#: The same words in a text as it stands.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = "struct<n_words: bigint, n_hit: bigint, item_ids: array<string>, spans: array<struct<start: int, end: int>>, hit: array<bigint>>"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def normal(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[str, int]]:
    """Windows between spaces, as one letter per byte, with their number of words."""
    if words:
        n = min(size, len(words))
        for i in range(len(words) - n + 1):
            yield (b" " + b" ".join(words[i : i + n]) + b" ").decode("latin-1"), n


def automaton(items: list[tuple[str, bytes]]):
    import ahocorasick

    holders: dict[str, tuple[int, set[str]]] = {}
    for item_id, text in items:
        for window, n in windows(normal(text)):
            holders.setdefault(window, (n, set()))[1].add(item_id)
    found = ahocorasick.Automaton()
    for window, (n, ids) in holders.items():
        found.add_word(window, (n, tuple(ids)))
    if holders:
        found.make_automaton()
    return found


def scan(found, text: bytes) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, hit word numbers, items."""
    words = normal(text)
    if not words or not len(found):
        return len(words), np.empty(0, np.int64), set()
    line = b" " + b" ".join(words) + b" "
    ends, items = [], set()
    for at, (n, ids) in found.iter(line.decode("latin-1")):
        ends.append((at, n))
        items.update(ids)
    if not ends:
        return len(words), np.empty(0, np.int64), items
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(spaces, [at for at, _ in ends])  # the space that ends word number last - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - [n for _, n in ends], 1)
    np.add.at(change, last, -1)
    return len(words), np.flatnonzero(np.cumsum(change[:-1]) > 0), items


def offsets(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Neighbouring hit words as character spans of the original text."""
    places = [m.span() for m in WORD.finditer(text)]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": places[r[0]][0], "end": places[r[-1]][1]} for r in runs]


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, utf8, found): each row of ``docs`` and what was found. No shuffle while the items fit one automaton."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("id"), utf8().alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // PART_CHARS) or 1
    out = docs.select(whole_row(docs), utf8().alias("utf8"), F.lit(None).cast(RESULT).alias("found"))
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        # PART_CHARS characters, give or take the evenness of a hash.
        shared = spark.sparkContext.broadcast([(r["id"], bytes(r["text"])) for r in some.collect()])
        out = out.mapInArrow(scanner(shared), out.schema)
    return out


def scanner(shared):
    """A task function that adds one automaton's hits to ``found``."""
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(SPAN)), ("hit", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = automaton(shared.value)
        for batch in batches:
            rows = []
            for text, before in zip(batch.column("utf8"), batch.column("found"), strict=True):
                text, before = text.as_py(), before.as_py()
                n, hit, ids = scan(held, text)
                if before is not None:
                    hit, ids = np.union1d(hit, np.array(before["hit"], np.int64)), ids.union(before["item_ids"])
                spans = offsets(text.decode(), hit) if len(hit) else []
                rows.append({"n_words": n, "n_hit": len(hit), "item_ids": sorted(ids), "spans": spans, "hit": hit.tolist()})
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("utf8"), pa.array(rows, kind)], names=["row", "utf8", "found"]
            )

    return run


def is_contaminated():
    return F.expr(f"found.n_hit > 0 and {SHARE} * found.n_hit >= found.n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return find_contamination(docs, benchmark).where(~is_contaminated()).select("row.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans; one row per document."""
    return find_contamination(docs.select("doc_id", "text"), benchmark).select(
        "row.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.item_ids"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        "found.spans",
    )
