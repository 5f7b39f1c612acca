"""Near-duplicate passages by compact windows.

The tokens of a text are its runs of five words. Under a min-hash function, all stretches of at least ``SPAN`` tokens
whose minimum is the same token form one compact window (left, centre, right): a node of the Cartesian tree over the
tokens' hashes. There are about 2 / SPAN windows a token, whatever the number of stretches they stand for, and two
texts that share a passage share the signature of a window over it.

1. Windows of ``HASHES`` functions are grouped by signature; a signature in two documents has a leader, the document
   of the smallest id, and every other document's windows are candidates for passages of the leader (no pairs within
   a group).
2. Candidates are united per document and leader over functions and neighbouring windows to intervals.
3. Intervals are cut from the texts and compared with the leader's tokens: stretches of ``SPAN`` tokens of which
   enough occur in the leader for a Jaccard similarity of 0.75 are kept, and their union is a passage. The members of
   one leader are split over as many groups as their size asks for, so a passage in a third of all documents is no
   task of its own.
4. Stretches that aren't near their leader go into further rounds. In each, the tokens that leaders met so far have
   don't count any more: the least of the others, under each of ``HASHES`` new functions, is the stretch's next
   signature, and the smallest document that shares it the next leader. Documents that share nothing but a common
   line lose that line after one round and have no signature in common any more, while those that are near each other
   share most of what their leader lacks. A stretch without tokens left has its own hash as signature. A stretch is
   done when it is near a leader or shares its signature with no other document; rounds end when all are, after
   ``SPAN`` + 1 at most. Equal stretches have the same signatures and leaders throughout, so exact repeats are found
   whatever the leaders; a near one is missed where every signature it shares leads to far leaders until the end.
   Stretches travel in runs of at most ``RUN``, so a round's rows are of bounded size.

Words are runs of bytes other than space and tab to carriage return, A-Z in lower case; words count from 0 and ends
are exclusive. Null, empty and short texts have no passages. Repeats inside one document don't count; rows that share
a ``doc_id`` are one document. Rows without id are left out. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import SPACE_BYTES, Chunk, chunks, hash_runs, land, mix, utf8

K, SPAN, HASHES = 5, 46, 3
#: Of SPAN tokens, so many must occur in the other text: |a and b| / |a or b| >= 0.75 for stretches of equal size.
ENOUGH = -(-6 * SPAN // 7)
#: Tokens of members compared with a leader in one group.
GROUP = 1_000_000
#: Stretches of a run that goes into further rounds, and stretches whose positions are numbered together.
RUN, BLOCK = 128, 4_000_000
LOW = np.uint64((1 << 24) - 1)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    best, reach = values, 1
    while 2 * reach <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def compact_windows(tokens: np.ndarray, valid: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, and the first and last start of the stretches of SPAN tokens that it is the minimum of.

    ``valid`` has the starts of stretches inside one text; the leftmost of equal tokens counts.
    """
    with np.errstate(over="ignore"):
        order = mix(tokens + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) & ~LOW
    least = sliding_minimum(order | np.arange(len(tokens), dtype=np.uint64), SPAN)
    centre = (least[valid] & LOW).astype(np.int64)
    new = np.concatenate([[True], (centre[1:] != centre[:-1]) | (np.diff(valid) > 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return centre[first], valid[first], valid[last]


def window_rows(docs: DataFrame) -> DataFrame:
    """(signature, doc_id, place): place packs centre, tokens to its left and to its right (below SPAN each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for start, texts in chunks(batch, "_utf8"):
                chunk = Chunk(texts, SPACE_BYTES)
                n = np.maximum(chunk.count - (K - 1) - (SPAN - 1), 0)  # stretches in each text
                if not n.sum():
                    continue
                tokens = hash_runs(chunk.words, K)
                for text, first, size in _blocks(n):
                    starts = chunk.first[text] + first
                    base, stop = int(starts[0]), int(starts[-1] + size[-1]) + SPAN - 1
                    some = tokens[base:stop]
                    valid = np.arange(size.sum()) + np.repeat(starts - base - np.cumsum(size) + size, size)
                    owner = np.repeat(np.arange(len(chunk.count)), chunk.count)[base:stop]
                    for turn in range(HASHES):
                        centre, first, last = compact_windows(some, valid, turn)
                        who = owner[centre]
                        place = centre + base - chunk.first[who]
                        left, right = centre - first, last + SPAN - 1 - centre
                        with np.errstate(over="ignore"):
                            sign = mix(some[centre] ^ np.uint64(turn))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(sign.view(np.int64)), pa.array(ids[start + who]),
                                pa.array((place << 16 | left << 8 | right).astype(np.int64)),
                            ],
                            names=["signature", "doc_id", "place"],
                        )

    return docs.mapInArrow(run, "signature long, doc_id long, place long")


def _blocks(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, first stretch and number of stretches, so many at a time that positions fit the low bits of an order.

    A text of more stretches comes in pieces; windows reach no further than a stretch, so pieces lose none.
    """
    some, held = [], 0
    for i in np.flatnonzero(n).tolist():
        for first in range(0, int(n[i]), BLOCK):
            size = min(BLOCK, int(n[i]) - first)
            if some and held + size > BLOCK:
                yield tuple(np.array(c, np.int64) for c in zip(*some, strict=True))
                some, held = [], 0
            some.append((i, first, size))
            held += size
    if some:
        yield tuple(np.array(c, np.int64) for c in zip(*some, strict=True))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, leader, low, high): token intervals that may hold a passage of the leader."""
    rows = window_rows(docs)
    shared = (
        rows.groupBy("signature")
        .agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("_last"))
        .where("leader < _last")
        .select("signature", "leader")
    )
    centre = F.expr("place >> 16")
    found = rows.join(shared, "signature").where("doc_id <> leader").select(
        "doc_id", "leader",
        (centre - F.expr("(place >> 8) & 255")).alias("low"),
        (centre + F.expr("place & 255") + 1).alias("high"),
    )
    return united(found, ["doc_id", "leader"], "low", "high")


def united(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Overlapping or touching intervals of a key as one."""
    by_low = Window.partitionBy(*keys).orderBy(low, high)
    before = by_low.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.groupBy(*keys, low).agg(F.max(high).alias(high))
    apart = F.coalesce(F.col(low) > F.max(high).over(before), F.lit(True)).cast("int")
    return (
        rows.withColumn("_apart", apart)
        .withColumn("_run", F.sum("_apart").over(by_low))
        .groupBy(*keys, "_run")
        .agg(F.min(low).alias(low), F.max(high).alias(high))
        .drop("_run")
    )


def enough(hit: np.ndarray) -> np.ndarray:
    """Whether each stretch of SPAN tokens has enough hits, by its first."""
    sums = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=sums[1:])
    return sums[SPAN:] - sums[:-SPAN] >= ENOUGH


def covered(good: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie inside a stretch of SPAN tokens with enough hits, from :func:`enough`."""
    mask = np.zeros(size, bool)
    edges = np.flatnonzero(np.diff(good, prepend=False, append=False))
    for first, end in edges.reshape(-1, 2).tolist():
        mask[first : end - 1 + SPAN] = True
    return mask


def places(names: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token would stand among sorted ``names``, and whether it is one of them."""
    at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
    return at, names[at] == tokens


def left_over(tokens: np.ndarray, hit: np.ndarray, good: np.ndarray) -> np.ndarray:
    """First token of the stretches of SPAN tokens that aren't near the leader (``good`` has those that are).

    A leader answers for the stretches whose minimum under the first function is a token of its own; others have
    another leader under that function, or none.
    """
    if good.all():
        return np.empty(0, np.int64)
    out = []
    for start in range(0, len(good), BLOCK):
        some = tokens[start : start + BLOCK + SPAN - 1]
        centre, first, last = compact_windows(some, np.arange(len(some) - SPAN + 1), 0)
        out.append(start + np.flatnonzero(np.repeat(hit[start + centre], last - first + 1)))
    at = np.concatenate(out)
    return at[~good[at]]


def carve(starts: np.ndarray, tokens: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """First token, tokens and which of them count, of the runs of stretches that begin at ``starts``."""
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    for run in np.split(starts, cuts) if len(starts) else []:
        for at in range(0, len(run), RUN):
            low, high = int(run[at]), int(run[min(at + RUN, len(run)) - 1]) + SPAN
            yield low, tokens[low:high].tobytes(), live[low:high].astype(np.uint8).tobytes()


def hash_stretches(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of :func:`hash_runs` of the stretches of SPAN tokens that begin at ``starts``, in order, alone."""
    need = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(need, starts, 1)
    np.add.at(need, starts + SPAN, -1)
    held = np.cumsum(need[:-1]) > 0
    return hash_runs(tokens[held], SPAN)[(np.cumsum(held) - 1)[starts]]


def signs(tokens: np.ndarray, live: np.ndarray, valid: np.ndarray, turn: int) -> np.ndarray:
    """The signature of each stretch that begins at ``valid``: of its live tokens, or of the whole if it has none."""
    with np.errstate(over="ignore"):
        order = mix(tokens + np.uint64(HASHES + turn + 1) * np.uint64(0x9E3779B97F4A7C15)) & ~LOW
        order[~live] = ~LOW
        least = sliding_minimum(order | np.arange(len(tokens), dtype=np.uint64), SPAN)
        centre = (least[valid] & LOW).astype(np.int64)
        sign = mix(tokens[centre] ^ np.uint64(turn))
        none = ~live[centre]
        if none.any():
            sign[none] = mix(hash_stretches(tokens, valid[none]) ^ np.uint64(HASHES + turn))
    return sign


def runs(mask: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    for low, high in edges.reshape(-1, 2).tolist():
        inside = np.flatnonzero(hit[low:high])
        yield low + int(inside[0]), low + int(inside[-1]) + 1


FOUND = "turn int, doc_id long, first_word long, end_word long, partner_id long, tokens binary, live binary"


def found_rows(passages: list[tuple], left: list[tuple]) -> list[pa.Array]:
    """Columns of FOUND: passages (doc_id, first_word, end_word, partner_id), then runs (turn, doc_id, low, tokens, live)."""
    rows = [(None, *p, None, None) for p in passages] + [(t, i, low, None, None, *data) for t, i, low, *data in left]
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
    return [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]


FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def compare(table: pa.Table) -> pa.Table:
    """Passages of the members of one leader, and of the leader; runs of members' stretches that aren't near it."""
    ids, leads, lows, tokens = (table.column(c).to_pylist() for c in ("doc_id", "leader", "low", "tokens"))
    leader = leads[0]
    # Rows that share the leader's id are one document.
    own = [np.frombuffer(t, np.uint64) for t in sorted({t for i, t in zip(ids, tokens, strict=True) if i == leader})]
    names = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
    out: list[tuple[int, int, int, int]] = []
    rest: list[tuple] = []
    if len(names):
        met = [np.zeros(len(o), bool) for o in own]
        known = [np.searchsorted(names, o) for o in own]
        partner = None
        for i, low, data in zip(ids, lows, tokens, strict=True):
            if i == leader:
                continue
            some = np.frombuffer(data, np.uint64)
            if len(some) < SPAN:
                continue
            at, hit = places(names, some)
            good = enough(hit)
            if good.any():
                mask = covered(good, len(some))
                out += [(i, low + a, low + b + K - 1, leader) for a, b in runs(mask, hit)]
                seen = np.zeros(len(names), bool)
                seen[at[mask & hit]] = True
                for o, m in zip(known, met, strict=True):
                    back = seen[o]
                    for a, b in runs(covered(enough(back), len(back)), back) if len(back) >= SPAN else []:
                        m[a:b] = True
                partner = i if partner is None else min(partner, i)
            rest += [(-1, i, low + first, *data) for first, *data in carve(left_over(some, hit, good), some, ~hit)]
        for m in met if partner is not None else []:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(np.int8), [0]])))
            out += [(leader, a, b + K - 1, partner) for a, b in edges.reshape(-1, 2).tolist()]
    return pa.table(found_rows(out, rest), names=FOUND_NAMES)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, which bounds what their runs' tokens take."""
    for batch in batches:
        for start in range(0, len(batch), 1_000):
            yield batch.slice(start, 1_000)


def joined_runs(tokens: list[bytes], live: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of runs in a row, which of them count, and the first place and length of each run."""
    length = np.array([len(x) for x in live], np.int64)
    marks = np.frombuffer(b"".join(live), np.uint8) > 0
    return np.frombuffer(b"".join(tokens), np.uint64), marks, np.cumsum(length) - length, length


def stretches(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of all stretches of some runs, and how many each run has."""
    n = length - SPAN + 1
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n), n


def sign_rows(left: DataFrame) -> DataFrame:
    """(key, turn, run, doc_id): the signatures of each run's stretches; turn -1 stands for every function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches):
            tokens, live, first, length = joined_runs(*(some.column(c).to_pylist() for c in ("tokens", "live")))
            turns = some.column("turn").to_numpy()
            for turn in range(HASHES):
                who = np.flatnonzero((turns == turn) | (turns < 0))
                if not len(who):
                    continue
                valid, n = stretches(first[who], length[who])
                owner = np.repeat(who, n)
                sign = signs(tokens, live, valid, turn)
                new = np.flatnonzero(np.concatenate([[True], (sign[1:] != sign[:-1]) | (np.diff(owner) > 0)]))
                columns = [pa.array(sign[new].view(np.int64)), pa.array(np.full(len(new), turn, np.int32))]
                columns += [some.column(c).take(pa.array(owner[new])) for c in ("run", "doc_id")]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "turn", "run", "doc_id"])

    return left.mapInArrow(run, "key long, turn int, run long, doc_id long")


def same_sign(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Which stretches of each row's run have the row's key as their signature; all rows are signed at once."""
    tokens, live, first, length = joined_runs(*(batch.column(c).to_pylist() for c in ("tokens", "live")))
    turns, keys = batch.column("turn").to_numpy(), batch.column("key").to_numpy()
    out = [np.empty(0, bool)] * len(batch)
    for turn in np.unique(turns).tolist():
        who = np.flatnonzero(turns == turn)
        valid, n = stretches(first[who], length[who])
        same = signs(tokens, live, valid, turn).view(np.int64) == np.repeat(keys[who], n)
        for i, found in zip(who.tolist(), np.split(same, np.cumsum(n)[:-1]), strict=True):
            out[i] = found
    return out


def compare_runs(pairs: DataFrame) -> DataFrame:
    """Passages of runs and their next leaders; what isn't near goes on without the tokens of that leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "turn", "doc_id", "low", "tokens", "live", "leader", "lead_low", "lead_tokens"]
        for batch in pieces(batches):
            out, rest = [], []
            columns = [batch.column(c).to_pylist() for c in names]
            held = (None, None)
            for same, (key, turn, i, low, data, live, leader, lead_low, lead) in zip(same_sign(batch), zip(*columns, strict=True), strict=True):
                some, live = np.frombuffer(data, np.uint64), np.frombuffer(live, np.uint8) > 0
                if held[0] != lead:  # a leader's rows come one after another
                    held = (lead, np.sort(np.frombuffer(lead, np.uint64)))
                hit = places(held[1], some)[1]
                good = enough(hit) & (i != leader)
                if good.any():
                    own, mask = np.frombuffer(lead, np.uint64), covered(good, len(some))
                    out += [(i, low + a, low + b + K - 1, leader) for a, b in runs(mask, hit)]
                    back = places(np.sort(some[mask]), own)[1]
                    out += [(leader, lead_low + a, lead_low + b + K - 1, i) for a, b in runs(covered(enough(back), len(back)), back)]
                # Another run of the leader's own document isn't its partner, but may be one of those that go on.
                starts = np.flatnonzero(same & ~good)
                rest += [(turn, i, low + first, *more) for first, *more in carve(starts, some, live & ~hit)]
            yield pa.RecordBatch.from_arrays(found_rows(out, rest), names=FOUND_NAMES)

    return pairs.mapInArrow(run, FOUND)


def next_leaders(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, turn, run, doc_id, lead_run, leader) of runs that share a signature, and the runs with a name each."""
    name = F.xxhash64("turn", "doc_id", "first_word", "tokens", "live").alias("run")
    left = left.select(name, "turn", "doc_id", F.col("first_word").alias("low"), "tokens", "live")
    keys = land(sign_rows(left), "keys")
    shared = (
        keys.groupBy("key")
        .agg(F.min(F.struct("doc_id", "run")).alias("l"), F.max("doc_id").alias("_last"))
        .where("l.doc_id < _last")
        .select("key", F.col("l.doc_id").alias("leader"), F.col("l.run").alias("lead_run"))
    )
    # Landed, so that the join has two plain exchanges and a hot signature can be split.
    shared = land(shared, "shared")
    pairs = keys.join(shared.hint("merge"), "key").where("run <> lead_run or doc_id <> leader").dropDuplicates(["key", "run", "doc_id"])
    return land(pairs, "pairs"), left


def further_rounds(left: DataFrame) -> list[DataFrame]:
    """Passages (doc_id, first_word, end_word, partner_id) of the runs ``left``, round by round until none is left."""
    out = []
    while True:
        pairs, named = next_leaders(left)
        if pairs.isEmpty():
            return out
        asked = pairs.select("run", "doc_id").union(pairs.select("lead_run", "leader")).distinct()
        held = land(named.join(asked.hint("merge"), ["run", "doc_id"], "left_semi").dropDuplicates(["run", "doc_id"]), "runs")
        leads = held.select(
            F.col("run").alias("lead_run"), F.col("doc_id").alias("leader"),
            F.col("low").alias("lead_low"), F.col("tokens").alias("lead_tokens"),
        )
        both = pairs.join(held.drop("turn").hint("merge"), ["run", "doc_id"]).join(leads.hint("merge"), ["lead_run", "leader"])
        found = land(compare_runs(both), "round")
        out.append(found.where("tokens is null").select("doc_id", "first_word", "end_word", "partner_id"))
        left = found.where("tokens is not null")


def tokens_of(needs: DataFrame) -> DataFrame:
    """(leader, salt, doc_id, low, tokens) from (doc_id, _utf8, leads, members): what each text sends where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, texts in chunks(batch, "_utf8"):
                chunk = Chunk(texts, SPACE_BYTES)
                tokens = hash_runs(chunk.words, K)
                rows = []
                for i, (first, n) in enumerate(zip(chunk.first.tolist(), chunk.count.tolist(), strict=True)):
                    own, doc_id = tokens[first : first + max(0, n - K + 1)], ids[start + i]
                    for salt in range(batch.column("leads")[start + i].as_py() or 0):
                        rows.append((doc_id, salt, doc_id, 0, own.tobytes()))
                    for m in batch.column("members")[start + i].as_py() or []:
                        rows.append((m["leader"], m["salt"], doc_id, m["low"], own[m["low"] : m["high"]].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["leader", "salt", "doc_id", "low", "tokens"],
                    )

    return needs.mapInArrow(run, "leader long, salt int, doc_id long, low long, tokens binary")


def find_passages(docs: DataFrame) -> DataFrame:
    """doc_id, first_word, end_word, partner_id: the passages of each document that occur in another, too."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_utf8"))
    pairs = land(candidates(texts), "intervals")
    leads = pairs.groupBy(F.col("leader").alias("doc_id")).agg(
        F.ceil(F.sum(F.col("high") - F.col("low")) / GROUP).cast("int").alias("leads")
    )
    salted = pairs.join(leads.select(F.col("doc_id").alias("leader"), "leads"), "leader").select(
        "doc_id", F.struct("leader", F.pmod(F.xxhash64("doc_id"), F.col("leads")).cast("int").alias("salt"), "low", "high").alias("m")
    )
    members = salted.groupBy("doc_id").agg(F.collect_list("m").alias("members"))
    needs = land(leads.join(members, "doc_id", "full"), "needs")
    found = tokens_of(texts.join(needs.hint("merge"), "doc_id")).groupBy("leader", "salt").applyInArrow(
        compare, FOUND
    )
    found = land(found, "found")
    near = found.where("tokens is null").select("doc_id", "first_word", "end_word", "partner_id")
    for more in further_rounds(found.where("tokens is not null")):
        near = near.unionByName(more)
    found = land(near, "passages")
    spans = united(found.select("doc_id", "first_word", "end_word"), ["doc_id"], "first_word", "end_word")
    partner = found.groupBy("doc_id").agg(F.min("partner_id").alias("partner_id"))
    return spans.join(partner, "doc_id").select("doc_id", "first_word", "end_word", "partner_id")
