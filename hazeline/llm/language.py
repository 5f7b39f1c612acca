"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it from left to right into
the longest phrases the automaton contains (Ziv and Merhav); z phrases over n letters against a sample of m letters
estimate the cross-entropy z * log2(m) / n, and the language with the fewest normalised phrases wins.

Samples are bounded: ``SAMPLE_DOCS`` labelled documents a language, in order of a hash of their id, up to
``SAMPLE_BYTES`` of normalised text. Documents of at most ``SAMPLE_LONGEST`` characters come first and are taken whole;
of longer ones, which follow where a language hasn't enough others, so many characters are taken. Automata are turned into
one transition table per language, in which a missing transition leads on from the root and marks a phrase end, so
whole texts are parsed in blocks of ``BLOCK`` letters, thousands of blocks side by side, one gather per letter.

A null text, or one without letters, is ``und`` with score 0; so is every text when nothing was learned. Of equal
languages the first in the alphabet wins. Rows without an id, language or text aren't learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.llm.common import utf8, whole_row
from hazeline.llm.encoding import release_encoders

SAMPLE_DOCS, SAMPLE_LONGEST, SAMPLE_BYTES = 96, 6_000, 24_000
BLOCK = 512
#: Letters of blocks parsed side by side.
SIDE_BY_SIDE = 4_000_000
UNKNOWN = "und"
SYMBOLS = 64
#: ASCII letters in lower case and all bytes beyond ASCII; the rest are spaces.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
#: A space is 0, a to z are 1 to 26, bytes beyond ASCII share the next 32 numbers.
SYMBOL = bytes(b - 96 if 97 <= b <= 122 else 27 + (b & 31) if b > 127 else 0 for b in range(256))
#: How fast the score falls off with the distance to the best entropy, in bits a letter.
SHARPNESS = 6.0


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(LETTER_BYTES).split()).translate(SYMBOL)


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of every state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at, last = last, new
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at < 0:
            continue
        to = step[at][c]
        if length[to] == length[at] + 1:
            link[new] = to
            continue
        copy = len(step)
        step.append(dict(step[to]))
        length.append(length[at] + 1)
        link.append(link[to])
        link[to] = link[new] = copy
        while at >= 0 and step[at].get(c) == to:
            step[at][c] = copy
            at = link[at]
    return step


def table(symbols: bytes) -> np.ndarray:
    """next * 2 + (1 where a phrase ends before the letter), by state * SYMBOLS + letter; next is premultiplied.

    The last state follows a letter that the sample lacks, which is a phrase of its own.
    """
    step = suffix_automaton(symbols)
    anew = np.full(SYMBOLS, len(step), np.int64)
    for c, to in step[0].items():
        anew[c] = to
    out = np.tile((anew * SYMBOLS << 1) | 1, (len(step) + 1, 1))
    for state, steps in enumerate(step):
        if steps:
            out[state, list(steps)] = np.array(list(steps.values()), np.int64) * SYMBOLS << 1
    return out.ravel().astype(np.int32)


class Model:
    """Labels and transition tables; small, and bounded by the sample's parameters for each language."""

    def __init__(self, labels: list[str], tables: list[np.ndarray], bits: np.ndarray):
        self.labels, self.tables, self.bits = labels, tables, bits

    @classmethod
    def fit(cls, samples: dict[str, bytes]) -> Model:
        labels = sorted(k for k, v in samples.items() if v)
        bits = np.log2([max(2, len(samples[k])) for k in labels])
        return cls(labels, [table(samples[k]) for k in labels], bits)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases by language and text."""
        ids, blocks = [], []
        for i, text in enumerate(texts):
            for at in range(0, len(text), BLOCK):
                ids.append(i)
                blocks.append(text[at : at + BLOCK])
        out = np.zeros((len(self.labels), len(texts)), np.int64)
        if not blocks:
            return out
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        letters = np.frombuffer(b"".join(blocks[i].ljust(BLOCK, b"\0") for i in order), np.uint8)
        letters = np.ascontiguousarray(letters.reshape(len(blocks), BLOCK).T)
        active = np.searchsorted(-sizes[order], -np.arange(BLOCK), side="left")  # blocks longer than t
        owner = np.array(ids)[order]
        for k, steps in enumerate(self.tables):
            state, ends = np.zeros(len(blocks), np.int32), np.ones(len(blocks), np.int32)
            for t in range(BLOCK):
                n = active[t]
                if not n:
                    break
                move = steps.take(state[:n] + letters[t, :n])
                ends[:n] += move & 1
                np.right_shift(move, 1, out=state[:n])
            # A block's first letter never ends a phrase: the root has no phrase behind it.
            first = steps.take(letters[0].astype(np.int32)) & 1
            np.add.at(out[k], owner, ends - first)
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        some: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal some, held
            found = self.phrases(some) * self.bits[:, None] / np.maximum(1, [len(s) for s in some])
            best = found.argmin(axis=0)
            score = 1 / np.exp(-SHARPNESS * (found - found.min(axis=0))).sum(axis=0)
            out.extend((self.labels[b], float(s)) for b, s in zip(best, score, strict=True))
            some, held = [], 0

        keep = []
        for text in texts:
            symbols = normal(text) if self.labels else b""
            known = any(symbols) and (symbols.translate(None, bytes(range(27, SYMBOLS))).strip(b"\0") or has_letter(text))
            keep.append(bool(known))
            if known:
                some.append(symbols)
                held += len(symbols)
                if held > SIDE_BY_SIDE:
                    flush()
        if some:
            flush()
        found = iter(out)
        return [next(found) if k else (UNKNOWN, 0.0) for k in keep]


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id's text, mod 4, is 2."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled documents that aren't held out."""
    size = F.length("text")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()).where(size > 0)
    by_hash = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    chosen = (
        rows.select("doc_id", F.col("lang").cast("string").alias("lang"), (size > SAMPLE_LONGEST).alias("long"))
        .withColumn("place", F.row_number().over(by_hash))
        .where(F.col("place") <= SAMPLE_DOCS)
        .collect()
    )  # SAMPLE_DOCS rows a language
    places = {r["doc_id"]: r["place"] for r in chosen}
    texts = (
        rows.where(F.col("doc_id").isin(list(places)))
        .select("doc_id", F.col("lang").cast("string").alias("lang"), F.substring("text", 1, SAMPLE_LONGEST).alias("text"))
        .select("doc_id", "lang", utf8().alias("text"))
        .collect()
        if places
        else []
    )
    samples: dict[str, bytearray] = {}
    for r in sorted(texts, key=lambda r: (places[r["doc_id"]], r["doc_id"], bytes(r["text"]))):
        held = samples.setdefault(r["lang"], bytearray())
        if len(held) < SAMPLE_BYTES:
            held += normal(bytes(r["text"])) + b"\0"
    return Model.fit({k: bytes(v) for k, v in samples.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score) of each row of ``docs``; no shuffle. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.tables, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()  # before the tables are loaded: a worker that packed texts may serve this step, too
        fitted = Model(*shared.value)
        for batch in batches:
            found = fitted.predict(batch.column("utf8").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    rows = docs.select(whole_row(docs), utf8().alias("utf8"))
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *added]))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those in no language; without null or letterless texts alone where nothing was learned."""
    model = learn(docs)
    if not model.labels:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    return identify(docs, model).where(F.col("lang_pred") != UNKNOWN).select("row.*")
