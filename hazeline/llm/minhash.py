"""Near copies by a multi-index Hamming join of b-bit min-hash signatures.

A document's set holds the hashes of its runs of four words; documents with equal sets are one class. The signature of a
class has 64 symbols of 16 bits, each from the least value that one hash function takes on the set: two sets of similarity
J differ in a symbol with probability 1 - J (all but 2 ** -16 of it). A pair counts as a candidate if its signatures differ in
at most 29 symbols, which a pair of similarity 0.8 exceeds with probability 1.2e-6, one of 0.85 with 1.5e-9.

*Pigeonhole.* The symbols are cut into 15 chunks. 29 differences leave at least one chunk with at most one, so for each chunk
all ways to leave out one symbol are enumerated: 64 keys a class, and every pair within the distance has a key in common.

*Linking.* Pairs within a group of near copies are never formed. Of each key's classes a few leaders are chosen, those that
meet most other classes, by a sum Spark combines before the shuffle; each class is compared with the leaders it shares most
keys with. Links make components. What is left are pairs in different components, and all of those within the distance that
share a key are compared, but for classes that can't have a link any more: a link takes 4/9 of the two sizes as common
shingles, so both classes need that many shingles that occur in other components, and sketches of 2,048 bits must be near
enough. But for the errors of signature and sketch, no pair within the distance is left out
whose link would unite two components. The cost of that last step grows with the square of a group only where its documents
share nearly all they have without being linked.

Sets are only made for classes of which 35 symbols or more occur in other classes; no other can have a candidate. (Symbols of
16 bits stop telling classes apart once millions share keys; then nothing is saved, and nothing lost.)

*Full sets.* Every link is decided by the sizes of the sets and of their intersection.

Words are runs of bytes other than space and tab to carriage return, A-Z in lower case. A text of fewer than four words has its
whole sequence as its shingle; one without words (or null) has none and is linked with nothing. Rows that share a ``doc_id``
but not the text are linked each on its own; rows that share both are one. A row without id is linked with nothing, gets a null
component and is kept. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import chunks, land, mix, utf8, whole_row
from hazeline.llm.components import components
from hazeline.llm.jaccard import FRAGMENT, Buckets, by_fragment, counted, digest, fragments_for, shingle_sets

#: Words of a shingle, and the similarity of a link in hundredths.
K, SIMILAR = 4, 80
SYMBOLS, BITS = 64, 16
#: Symbols a candidate's signatures may differ in, and the chunks that leave one of them with at most one difference.
DISTANCE, CHUNKS = 29, 15
#: Leaders of a key, leaders a class is compared with, and rounds of that before the rest is compared pair by pair.
LEADERS, BEST, ROUNDS = 2, 4, 2
PLANES = [f"s{i}" for i in range(BITS)]
#: Bits of the sketches that pairs of the last step are held against, and how many may differ, which
#: 4.4e-7 of pairs with a similarity of 0.8 exceed.
SKETCH, SKETCH_DISTANCE = 2048, 274
WORDS = [f"k{i}" for i in range(SKETCH // 64)]
_SEED = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Symbols of each set, zeros for an empty one; two hash functions from each 64-bit value."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    values = np.concatenate(sets)
    starts = (np.cumsum(sizes) - sizes)[full]
    for i in range(SYMBOLS // 2):
        with np.errstate(over="ignore"):
            halves = mix(values + np.uint64(i + 1) * _SEED).view(np.uint32)
        for half in (0, 1):
            out[full, 2 * i + half] = np.minimum.reduceat(halves[half::2], starts)
    return out


def to_planes(symbols: np.ndarray) -> np.ndarray:
    """BITS words of 64 bits a signature: word i has bit i of every symbol."""
    bits = np.unpackbits(np.ascontiguousarray(symbols, "<u2").view(np.uint8).reshape(-1, SYMBOLS, 2), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<i8").reshape(-1, BITS)


def from_planes(planes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(planes, "<i8").view(np.uint8).reshape(-1, BITS, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u2").reshape(-1, SYMBOLS)


def distance(a: str, b: str) -> Column:
    """Symbols in which the signatures of rows ``a`` and ``b`` differ."""
    return F.expr(f"bit_count({' | '.join(f'({a}.{p} ^ {b}.{p})' for p in PLANES)})")


def chunk_edges() -> list[int]:
    return [SYMBOLS * c // CHUNKS for c in range(CHUNKS + 1)]


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """A key for each symbol left out: the others of its chunk, at most four."""
    keys = np.empty((len(symbols), SYMBOLS), np.uint64)
    edges = chunk_edges()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        for out in range(low, high):
            packed = np.zeros(len(symbols), np.uint64)
            for i in range(low, high):
                if i != out:
                    packed = packed << np.uint64(BITS) | symbols[:, i].astype(np.uint64)
            with np.errstate(over="ignore"):
                keys[:, out] = mix(packed ^ mix(np.uint64(out + 1) * _SEED))
    return keys


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest and signature of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch, "_utf8"):
                sets = list(shingle_sets(texts, K))
                found = np.array([(len(s), *digest(s)) for s in sets], np.int64)
                planes = to_planes(signatures(sets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)), *[pa.array(c) for c in (*found.T, *planes.T)]],
                    names=["doc_id", "n_shingles", "d1", "d2", *PLANES],
                )

    kinds = ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "d1", "d2", *PLANES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_utf8")).mapInArrow(run, kinds)


def spread(nodes: DataFrame, name: str, values) -> DataFrame:
    """(name, q, node, component): a row for each of the SYMBOLS values that ``values`` gives for a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.slice(at, 1000)
                planes = np.stack([some.column(p).to_numpy() for p in PLANES], axis=1)
                columns = [values(from_planes(planes)).ravel().view(np.int64)]
                columns += [np.tile(np.arange(SYMBOLS, dtype=np.int32), len(some))]
                columns += [np.repeat(some.column(c).to_numpy(), SYMBOLS) for c in ("node", "component")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[name, "q", "node", "component"])

    return nodes.select("node", "component", *PLANES).mapInArrow(run, f"{name} long, q int, node long, component long")


def open_values(entries: DataFrame, name: str, *more: Column) -> DataFrame:
    """Values met in several components, with whatever ``more`` sums up."""
    found = entries.groupBy(name).agg(F.min("component").alias("_low"), F.max("component").alias("_high"), *more)
    return land(found.where("_low <> _high").drop("_low", "_high"), "open")


def close_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) within the distance and alike enough in size."""
    info = nodes.select("node", "n", *PLANES)
    for side in "ab":
        renamed = info.select(F.col("node").alias(side), F.struct("n", *PLANES).alias(f"_{side}"))
        pairs = pairs.join(renamed.hint("merge"), side)
    close = pairs.select("a", "b", F.col("_a.n").alias("na"), F.col("_b.n").alias("nb"), distance("_a", "_b").alias("d"))
    return land(close.where(f"d <= {DISTANCE} AND 100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)").select("a", "b"), "close")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, met): the keys nodes share, and how many classes a node meets in all of its keys."""
    entries = spread(nodes, "key", keys_of)
    keys = open_values(entries, "key", F.count("*").alias("met"))
    members = land(entries.join(keys.hint("merge"), "key").select("key", "node", "met"), "members")
    return land(members.select("key", "node").join(members.groupBy("node").agg(F.sum("met").alias("met")), "node"), "shared")


def leader_votes(members: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """(a, b, votes): how much the keys in which a node meets a leader of another component speak for it.

    In the first turn leaders are the classes that meet most others, those in the middle of a group, and each key counts
    once. Later turns draw leaders by hash, and a key counts for more the fewer classes share it: who differs from the
    middle of a group in the same way meets in rare keys.
    """
    named = land(members.join(nodes.select("node", "component"), "node"), "named")
    rank = -F.col("met") if turn == 0 else F.lit(0).cast("long")
    leaders = [
        F.min(F.struct(rank, F.xxhash64("node", F.lit(LEADERS * turn + i)), "node", "component")).alias(f"l{i}") for i in range(LEADERS)
    ]
    keys = open_values(named, "key", F.count("*").alias("size"), *leaders)
    each = F.explode(F.array_distinct(F.expr(f"transform(array({', '.join(f'l{i}' for i in range(LEADERS))}), l -> struct(l.node, l.component))")))
    met = named.join(keys.hint("merge"), "key").select("node", "component", "size", each.alias("l")).where("component <> l.component")
    weight = F.lit(1.0) if turn == 0 else 1 / F.col("size")
    return land(met.groupBy(F.col("node").alias("a"), F.col("l.node").alias("b")).agg(F.sum(weight).alias("votes")), "votes")


def nearest(votes: DataFrame) -> DataFrame:
    """(a, b) of each node with the BEST leaders that most speaks for."""
    best = votes.groupBy("a").agg(F.expr(f"slice(sort_array(collect_list(struct(-votes, b))), 1, {BEST})").alias("best"))
    return best.select("a", F.explode("best.b").alias("b"))


def viable(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node) with so many symbols that occur in other classes, too, that it may have a candidate."""
    some = members.select("node").distinct().join(nodes, "node")
    places = spread(some, "place", lambda symbols: np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(BITS) | symbols.astype(np.uint64))
    shared = places.join(open_values(places, "place"), "place").groupBy("node").count()
    return land(shared.where(f"count >= {SYMBOLS - DISTANCE}").select("node"), "viable")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH bits of each set, one from each of as many least values; bits differ with probability (1 - J) / 2."""
    bits = np.zeros((len(sets), SKETCH), np.uint8)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    for i in range(SKETCH // 4):
        with np.errstate(over="ignore"):
            quarters = mix(values ^ np.uint64(i + 1) * _SEED).view(np.uint16)
        for q in range(4):
            bits[:, 4 * i + q] = np.minimum.reduceat(quarters[q::4], starts) & 1
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def sets_for(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, shingles, sketch) of the nodes ``asked`` for."""
    asked = land(classes.join(asked, "node").select("node", "first_id"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            for start, texts in chunks(batch, "_utf8"):
                found = [
                    (node, s)
                    for node, s in zip(nodes[start:], shingle_sets(texts, K), strict=False)
                    if digest(s)[0] == node  # rows that share an id may hold other texts
                ]
                if found:
                    a, b = zip(*found, strict=True)
                    columns = [pa.array(a, pa.int64()), pa.array([x.tobytes() for x in b], pa.binary()), *[pa.array(c) for c in sketches(b).T]]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", *WORDS])

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("first_id"), utf8().alias("_utf8"))
    kinds = ", ".join(f"{w} long" for w in WORDS)
    # In one way at every size, so that costs grow evenly.
    found = texts.join(asked.hint("merge"), "first_id").select("node", "_utf8").mapInArrow(run, f"node long, shingles binary, {kinds}")
    return land(found.dropDuplicates(["node"]), "sets")


def shared_outside(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, m): how many shingles of a node occur in other components."""
    named = land(sets.join(nodes.select("node", "n", "component"), "node"), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    blobs = by_fragment(named.withColumns({"rank": F.lit(0).cast("long"), "m": F.col("n")}), fragments_for(total, FRAGMENT))

    def run(table: pa.Table) -> pa.Table:
        found = Buckets(table)
        which, times = counted(found.at)
        return pa.table({"node": pa.array(found.info[which, 0], pa.int64()), "m": pa.array(times, pa.int64())})

    return blobs.groupBy("part").applyInArrow(run, "node long, m long").groupBy("node").agg(F.sum("m").alias("m"))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_a"), batch.column("_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for side in "ab":
        renamed = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"_{side}"))
        pairs = pairs.join(renamed.hint("merge"), side)
    return pairs.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def relabel(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with their components after further links."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab")
    merged = components(found.join(a, "a").join(b, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    joined = nodes.join(merged, "component", "left").withColumn("component", F.coalesce("_to", "component"))
    return land(joined.select(*nodes.columns), "nodes")


def first_key(differ: str, q: str) -> str:
    """Whether ``q`` is the first symbol that two signatures may leave out to share a key.

    ``differ`` has a bit for each symbol in which they differ. Of the first chunk with at most one such symbol it is that
    symbol, or the chunk's first.
    """
    cases = []
    edges = chunk_edges()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        bits = (1 << high) - (1 << low)
        chunk = f"(x & {bits - (1 << 64) if bits >= 1 << 63 else bits}L)"
        cases.append(f"WHEN {chunk} = 0 THEN {q} = {low} WHEN ({chunk} & ({chunk} - 1)) = 0 THEN {chunk} = shiftleft(1L, {q})")
    return f"exists(array({differ}), x -> CASE {' '.join(cases)} ELSE false END)"


def remaining_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) in different components that are within the distance, have near sketches and may be linked.

    A pair comes up once, at the first key it shares.
    """
    # A partner has at least SIMILAR hundredths of a node's shingles.
    may = nodes.join(shared_outside(nodes, sets), "node").where(f"100 * m >= {SIMILAR} * n")
    may = land(may, "may")
    sketched = may.join(sets.select("node", *WORDS).hint("merge"), "node")
    entries = spread(may, "key", keys_of)
    left = entries.join(open_values(entries, "key").hint("merge"), "key").select("key", "q", "node")
    left = land(left.join(sketched.hint("merge"), "node"), "left")
    enough = f"{100 + SIMILAR} * least(a.m, b.m) >= {SIMILAR} * (a.n + b.n)"
    sketch = " + ".join(f"bit_count(a.{w} ^ b.{w})" for w in WORDS)
    differ = " | ".join(f"(a.{p} ^ b.{p})" for p in PLANES)
    alike = F.expr(
        f"a.key = b.key AND a.component < b.component AND {enough} AND {sketch} <= {SKETCH_DISTANCE} "
        f"AND bit_count({differ}) <= {DISTANCE} AND {first_key(differ, 'a.q')}"
    )
    both = left.alias("a").join(left.alias("b").hint("merge"), alike)
    return land(both.selectExpr("a.node AS a", "b.node AS b"), "pairs")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = land(describe(docs), "described")
    classes = land(
        rows.where("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy(F.col("d1").alias("node"), "d2", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("first_id"), *[F.min(p).alias(p) for p in PLANES]),
        "classes",
    )
    nodes = classes.select("node", "n", F.col("node").alias("component"), *PLANES)
    members = shared_keys(nodes)
    sets = sets_for(docs, classes, viable(nodes, members))
    for turn in range(ROUNDS):
        nodes = relabel(nodes, links(close_pairs(nearest(leader_votes(members, nodes, turn)), nodes), sets))
    nodes = relabel(nodes, links(remaining_pairs(nodes, sets), sets))
    named = classes.select("node", "d2", "n", "first_id").join(nodes.select("node", "component"), "node")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("node", "d2", "n", "component_id")
    on = [rows["d1"] == named["node"], rows["d2"] == named["d2"], rows["n_shingles"] == named["n"]]
    linked = (F.col("n_shingles") > 0) & rows["doc_id"].isNotNull()
    out = rows.join(named, on, "left").select(
        "doc_id", "n_shingles", F.when(linked, F.col("component_id")).otherwise(rows["doc_id"]).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without those linked, directly or by others, to one of a smaller id."""
    kept = near_copies(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("_id"))
    return rows.alias("l").join(kept.hint("merge").alias("r"), F.expr("l._id <=> r._id"), "left_semi").select("row.*")
