"""Set-similarity join on word shingles by vertical partitioning, for groups of any size.

A document's set holds the hashes of its runs of five words. Documents with equal sets are one class. The order of
all shingles (by hash) is cut into fragments; a fragment sees its part of every set, counts overlaps there, and the
partial counts are summed per pair, so no pair of sets is ever brought together.

Three things keep this whole and bounded:

1. *Screen.* Two linked sets share at least k of their first n - ceil(0.75 n) + k shingles in the global order. Only
   these prefixes are counted at first (five bytes a shingle), and classes whose prefix shares too little with all
   others drop out; most do. Their sets are never shuffled.
2. *Stars.* In every bucket (the classes that hold one shingle) only overlaps with the bucket's leader are counted,
   the class that comes first in a random order. A sum over fragments is a lower bound of the overlap with that
   leader; where it suffices, the pair is linked for certain. Groups of near copies fall together at a cost that is
   linear in their size, and the links make components.
3. *The rest, exactly.* A class can only have a link out of its component if 3/4 of its shingles occur in other
   components. For the few classes left, all pairs between different components that share a shingle are counted in
   full, so no link that would join two components is lost. Pairs within a component are never counted.

Words are runs of bytes other than space and tab to carriage return, A-Z in lower case. A text of fewer than five
words has its whole sequence as its shingle; one without words (or null) has none and is linked with nothing. Rows
that share a ``doc_id`` but not the text are linked each on its own; rows that share both are one. A row without id is
linked with nothing and gets a null component. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import SPACE_BYTES, Chunk, chunks, hash_runs, land, mix, utf8, whole_row
from hazeline.llm.components import components

K = 5
#: Shingles of one fragment, in memory at once; and of a fragment of the screen, which needs less for each. What a task
#: holds is the same at any size of the input once there are more than LEAST fragments.
FRAGMENT, SCREENED = 800_000, 2_000_000
#: Fragments there are at least, for small inputs to be spread, too.
LEAST = 16
#: Pairs formed, and distinct pairs gathered, at a time within a fragment.
PAIRS = 400_000
#: Rounds of stars before what is left is counted pair by pair.
STARS = 4
#: Share of a set that the screen looks at beyond the plain prefix.
EXTRA = 0.15
SALT = [np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)]


def shingle_sets(texts: list[bytes], k: int = K) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    chunk = Chunk(texts, SPACE_BYTES)
    runs = hash_runs(chunk.words, k)
    for first, n in zip(chunk.first.tolist(), chunk.count.tolist(), strict=True):
        if n >= k:
            yield np.unique(runs[first : first + n - k + 1])
        else:
            yield hash_runs(chunk.words[first : first + n], n) if n else np.empty(0, np.uint64)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(shingles ^ SALT[0]).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(shingles + SALT[1]), initial=np.uint64(0))
    return int(a.astype(np.int64)), int(np.uint64(b).astype(np.int64))


def extra(n: int) -> int:
    return max(1, int(EXTRA * n))


def fragment_of(shingles: np.ndarray, fragments: int) -> np.ndarray:
    """Even whatever part of the order the shingles come from."""
    return (mix(shingles) >> np.uint64(40)).astype(np.int64) % fragments


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and digest of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch, "_utf8"):
                found = [(len(s), *digest(s)) for s in shingle_sets(texts)]
                columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)), *columns], names=["doc_id", "n_shingles", "d1", "d2"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_utf8")).mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long"
    )


def shared_prefix(docs: DataFrame, fragments: int) -> DataFrame:
    """(d1, shared): how many of the first shingles of a set occur first in another set, too."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch, "_utf8"):
                kept: dict[int, np.ndarray] = {}  # equal sets once
                for s in shingle_sets(texts):
                    if n := len(s):
                        kept[digest(s)[0]] = s[: n - -(-3 * n // 4) + extra(n)]
                if not kept:
                    continue
                owner = np.repeat(np.arange(len(kept)), [len(s) for s in kept.values()]).astype("<u4")
                shingles = np.concatenate(list(kept.values()))
                own = np.array(list(kept), np.int64)
                part = fragment_of(shingles, fragments)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(fragments + 1))
                rows = []
                for p in np.flatnonzero(np.diff(edges)):
                    at = order[edges[p] : edges[p + 1]]
                    low = mix(shingles[at]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    who, place = np.unique(owner[at], return_inverse=True)
                    rows.append((int(p), own[who].tobytes(), place.astype("<u4").tobytes(), low.tobytes()))
                part_, a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_, pa.int32()), *[pa.array(x, pa.binary()) for x in (a, b, c)]],
                    names=["part", "own", "place", "low"],
                )

    blobs = docs.select(utf8().alias("_utf8")).mapInArrow(spread, "part int, own binary, place binary, low binary")
    found = blobs.groupBy("part").applyInArrow(count_prefixes, "d1 long, shared long")
    return found.groupBy("d1").agg(F.sum("shared").alias("shared"))


def count_prefixes(table: pa.Table) -> pa.Table:
    """(d1, shared) of one fragment of the screen: how many of its shingles here a set shares with another.

    A shingle and the row of its set in ``own`` are sorted as one word; only shingles met twice are looked at further.
    """
    own = np.empty(sum(len(x.as_buffer()) for x in table.column("own")) // 8, np.int64)
    code = np.empty(sum(len(x.as_buffer()) for x in table.column("place")) // 4, np.uint64)
    bits = np.uint64(24 if len(own) <= 1 << 24 else 32)
    sets = done = 0
    for who, place, low in zip(*[table.column(c) for c in ("own", "place", "low")], strict=True):
        who, place = np.frombuffer(who.as_buffer(), np.int64), np.frombuffer(place.as_buffer(), "<u4")
        wide = np.zeros((len(place), 8), np.uint8)
        wide[:, :5] = np.frombuffer(low.as_buffer(), np.uint8).reshape(-1, 5)
        own[sets : sets + len(who)] = who
        # Beside more than 16 million rows 32 of the 40 bits are left; equal ones by chance only let a set pass the screen.
        code[done : done + len(place)] = (wide.view("<u8").ravel() << bits) | (place + np.uint64(sets))
        sets, done = sets + len(who), done + len(place)
    code.sort()
    key = code >> bits
    again = key[1:] == key[:-1]
    met = np.zeros(len(code), bool)
    met[1:] = again
    met[:-1] |= again
    key, code = key[met], code[met]
    owner = own[(code & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts) if len(starts) else starts.astype(bool)
    who, n = np.unique(owner[np.repeat(several, sizes)], return_counts=True)
    return pa.table({"d1": pa.array(who, pa.int64()), "shared": pa.array(n, pa.int64())})


def sets_of(docs: DataFrame) -> DataFrame:
    """(node, n, rank, shingles) from (node, rank, _utf8): the set of each node, where the text is the one meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ranks = batch.column("node").to_pylist(), batch.column("rank").to_pylist()
            for start, texts in chunks(batch, "_utf8"):
                rows = [
                    (node, len(s), rank, s.tobytes())
                    for node, rank, s in zip(nodes[start:], ranks[start:], shingle_sets(texts), strict=False)
                    if digest(s)[0] == node  # rows that share an id may hold other texts
                ]
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["node", "n", "rank", "shingles"])

    return docs.mapInArrow(run, "node long, n long, rank long, shingles binary")


def fragments_for(shingles: int, size: int) -> int:
    return max(LEAST, -(-shingles // size))


#: What goes along with a node into its fragments.
INFO = ("node", "component", "rank", "n", "m")


def by_fragment(sets: DataFrame, fragments: int) -> DataFrame:
    """(part, info, place, shingles) from INFO and shingles: parts of many sets in a row."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                some = batch.slice(start, 1000)
                info = np.stack([some.column(c).to_numpy() for c in INFO], axis=1)
                each = [np.frombuffer(s.as_py(), np.uint64) for s in some.column("shingles")]
                shingles = np.concatenate(each)
                owner = np.repeat(np.arange(len(each)), [len(s) for s in each])
                part = fragment_of(shingles, fragments)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(fragments + 1))
                rows = []
                for p in np.flatnonzero(np.diff(edges)):
                    at = order[edges[p] : edges[p + 1]]
                    who, place = np.unique(owner[at], return_inverse=True)
                    rows.append((int(p), info[who].tobytes(), place.astype("<u4").tobytes(), shingles[at].tobytes()))
                if rows:
                    part_, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part_, pa.int32()), *[pa.array(x, pa.binary()) for x in rest]],
                        names=["part", "info", "place", "shingles"],
                    )

    return sets.select(*INFO, "shingles").mapInArrow(spread, "part int, info binary, place binary, shingles binary")


class Buckets:
    """A fragment's buckets with nodes of two or more components, ordered by shingle.

    ``info`` has a row of INFO for each node here, ``at`` the row of each entry.
    """

    def __init__(self, table: pa.Table):
        # Filled in place: lists of parts beside the whole would double what a fragment takes.
        size = {c: sum(len(x.as_buffer()) for x in table.column(c)) for c in ("info", "place")}
        self.info = np.empty((size["info"] // (8 * len(INFO)), len(INFO)), np.int64)
        at, shingle = np.empty(size["place"] // 4, np.int32), np.empty(size["place"] // 4, np.uint64)
        held = done = 0
        for some, place, own in zip(*[table.column(c) for c in ("info", "place", "shingles")], strict=True):
            some = np.frombuffer(some.as_buffer(), np.int64).reshape(-1, len(INFO))
            place = np.frombuffer(place.as_buffer(), "<u4")
            self.info[held : held + len(some)] = some
            at[done : done + len(place)] = place.astype(np.int32) + np.int32(held)
            shingle[done : done + len(place)] = np.frombuffer(own.as_buffer(), np.uint64)
            held, done = held + len(some), done + len(place)
        order = np.argsort(shingle, kind="stable")
        at, shingle = at[order], shingle[order]
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        sizes = np.diff(np.append(starts, len(shingle)))
        # Buckets inside one component hold no link that is still looked for.
        comp = self.info[at, 1]
        open_ = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        self.at, self.sizes = at[np.repeat(open_, sizes)], sizes[open_]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def leaders(self, turn: int) -> np.ndarray:
        """Row of the leader of each entry's bucket: the smallest rank, by chance among equals and anew each turn."""
        node, rank = self.info[:, 0], self.info[:, 2]
        by_chance = mix(node.view(np.uint64) + np.uint64(turn + 1) * SALT[0])
        first = np.empty(len(node), np.int32)
        first[np.lexsort((by_chance, rank))] = np.arange(len(node))
        least = np.minimum.reduceat(first[self.at], self.starts) if len(self.at) else first[:0]
        back = np.argsort(first)
        return np.repeat(back[least], self.sizes)


def counted(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their numbers summed (each counts once without ``n``)."""
    if n is None:
        return np.unique(code, return_counts=True)
    code, at = np.unique(code, return_inverse=True)
    return code, np.bincount(at, weights=n, minlength=len(code)).astype(np.int64)


def result(found: Buckets, code: np.ndarray, n: np.ndarray) -> pa.Table:
    node, size = found.info[:, 0], max(1, len(found.info))
    return pa.table(
        {"a": pa.array(node[code // size], pa.int64()), "b": pa.array(node[code % size], pa.int64()), "n": pa.array(n, pa.int64())}
    )


def count_stars(turn: int):
    """Overlaps with leaders of other components; a row (a, a) has the shingles of a that other components hold."""

    def run(table: pa.Table) -> pa.Table:
        found = Buckets(table)
        size = np.int64(max(1, len(found.info)))
        lead = found.leaders(turn)
        comp = found.info[:, 1]
        other = comp[found.at] != comp[lead]
        code, n = counted(found.at[other] * size + lead[other])
        # Every entry of an open bucket meets another component there.
        own, m = counted(found.at * (size + 1))
        return result(found, np.concatenate([code, own]), np.concatenate([n, m]))

    return run


def count_pairs(table: pa.Table) -> pa.Table:
    """Overlaps of all pairs in different components that meet in this fragment and may be linked."""
    found = Buckets(table)
    size = np.int64(max(1, len(found.info)))
    _, comp, _, n, m = found.info.T
    bucket = np.repeat(np.arange(len(found.sizes)), found.sizes)
    at = found.at[np.lexsort((comp[found.at], bucket))]
    # All but each bucket's largest component are paired with the whole bucket.
    new = np.ones(len(at), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (comp[at][1:] != comp[at][:-1])
    run = np.cumsum(new) - 1
    run_size, run_bucket = np.bincount(run, minlength=0), bucket[new]
    largest = np.lexsort((-run_size[: len(run_bucket)], run_bucket))
    first = np.ones(len(run_bucket), bool)
    first[1:] = run_bucket[largest][1:] != run_bucket[largest][:-1]
    minor = np.ones(len(run_bucket), bool)
    minor[largest[first]] = False
    entries = np.flatnonzero(minor[run]) if len(at) else np.empty(0, np.int64)
    weight = np.cumsum(found.sizes[bucket[entries]])
    code, total = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    begin = held = 0
    while begin < len(entries):
        end = max(begin + 1, int(np.searchsorted(weight, (weight[begin - 1] if begin else 0) + PAIRS)))
        some = entries[begin:end]
        many = found.sizes[bucket[some]]
        x = np.repeat(some, many)
        y = np.repeat(found.starts[bucket[some]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        a, b = at[x], at[y]
        # A pair of two minor entries comes up twice; it counts once.
        good = (comp[a] != comp[b]) & (~minor[run[y]] | (x < y))
        good &= 7 * np.minimum(m[a], m[b]) >= 3 * (n[a] + n[b])
        a, b = a[good].astype(np.int64), b[good].astype(np.int64)
        waiting.append(counted(np.minimum(a, b) * size + np.maximum(a, b)))
        held += len(waiting[-1][0])
        begin = end
        if held > PAIRS or begin >= len(entries):
            code, total = counted(
                np.concatenate([code, *[c for c, _ in waiting]]), np.concatenate([total, *[k for _, k in waiting]])
            )
            waiting, held = [], 0
    # What a pair may still share in all other fragments is bounded by what either of them has there.
    a, b = code // size, code % size
    elsewhere = m - np.bincount(found.at, minlength=len(m))
    may = 7 * (total + np.minimum(elsewhere[a], elsewhere[b])) >= 3 * (n[a] + n[b])
    code, total, a, b = code[may], total[may], a[may], b[may]
    # One of the pair has to be named first in all fragments: the smaller node.
    node = found.info[:, 0]
    swap = node[a] > node[b] if len(code) else np.empty(0, bool)
    return result(found, np.where(swap, b * size + a, code), total)


def links(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose summed overlaps suffice."""
    total = counts.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    a, b = (sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    # A quick bound first: it takes no join.
    both = total.join(a, "a").where("4 * n >= 3 * n_a").join(b, "b")
    return both.where("100 * n >= 75 * (n_a + n_b - n)").select("a", "b")


def relabel(state: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) after further links between nodes."""
    a, b = (state.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab")
    merged = components(found.join(a, "a").join(b, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    joined = state.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return land(joined, "components")


def link_sets(sets: DataFrame) -> DataFrame:
    """(node, component) from (node, n, rank, shingles): exact components of the similarity graph."""
    sizes = sets.select("node", "n")
    state = land(sets.select("node", F.col("node").alias("component")), "components")
    active = sets.withColumn("m", F.col("n"))
    for turn in range(STARS + 1):
        n = active.agg(F.sum("n")).first()[0] or 0
        # Pairs are best judged where as much of them as possible is in one place.
        fragments = fragments_for(n, FRAGMENT) if turn < STARS else max(1, -(-n // FRAGMENT))
        blobs = by_fragment(active.join(state, "node"), fragments).groupBy("part")
        if turn == STARS:
            counts = blobs.applyInArrow(count_pairs, "a long, b long, n long")
            return relabel(state, links(counts, sizes))
        counts = land(blobs.applyInArrow(count_stars(turn), "a long, b long, n long"), "counts")
        outside = counts.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("m"))
        left = active.drop("m").join(outside, "node").where("4 * m >= 3 * n")
        active = land(left.select("node", "n", "rank", "m", "shingles"), "active")
        state = relabel(state, links(counts, sizes))
        if active.isEmpty():
            return state
    return state


def viable_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, n, rank, shingles) of the classes that pass the screen; rank falls with what a prefix shares."""
    named = docs.where("doc_id is not null")
    n = classes.agg(F.sum("n_shingles")).first()[0] or 0
    # About 0.4 of the shingles belong to prefixes.
    shared = shared_prefix(named, fragments_for(2 * n // 5, SCREENED))
    # A partner may have a quarter fewer shingles, and so a shorter prefix.
    need = F.greatest(F.lit(1), F.floor(F.lit(0.74 * EXTRA) * F.col("n_shingles")))
    viable = classes.join(shared.withColumnRenamed("d1", "node"), "node").where(F.col("shared") >= need)
    texts = named.select(F.col("doc_id").cast("long").alias("first_id"), utf8().alias("_utf8"))
    once = Window.partitionBy("first_id", "node", F.xxhash64("_utf8")).orderBy("first_id")
    prefix = F.expr("n_shingles - (3 * n_shingles + 3) div 4") + F.greatest(F.lit(1), F.floor(F.lit(EXTRA) * F.col("n_shingles")))
    rank = -F.floor(64 * F.col("shared") / prefix)
    viable = viable.select("first_id", "node", rank.cast("long").alias("rank"))
    chosen = texts.join(viable.hint("merge"), "first_id").withColumn("_n", F.row_number().over(once))
    return land(sets_of(chosen.where("_n = 1").select("node", "rank", "_utf8")), "sets")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = land(describe(docs), "described")
    linked = rows.where("doc_id is not null and n_shingles > 0")
    classes = land(
        linked.groupBy(F.col("d1").alias("node"), "d2", "n_shingles").agg(F.min("doc_id").alias("first_id")), "classes"
    )
    found = link_sets(viable_sets(docs, classes))
    # Of each class: the smallest id of its component, which is itself where the screen left it out.
    named = classes.join(found, "node", "left").select(
        "node", "d2", "n_shingles", "first_id", F.coalesce("component", "node").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("node", "d2", "n_shingles", "component_id")
    on = [rows["d1"] == named["node"], rows["d2"] == named["d2"], rows["n_shingles"] == named["n_shingles"]]
    return rows.join(named, on, "left").select(
        "doc_id",
        rows["n_shingles"],
        F.when((rows["n_shingles"] > 0) & rows["doc_id"].isNotNull(), F.col("component_id")).otherwise(rows["doc_id"]).alias("component_id"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without those that are linked to one of a smaller id, directly or by others."""
    found = similar(docs).where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    rows = docs.select(whole_row(docs), "doc_id")
    return rows.alias("l").join(found.hint("merge").alias("r"), F.expr("l.doc_id <=> r.doc_id"), "left_semi").select("row.*")
