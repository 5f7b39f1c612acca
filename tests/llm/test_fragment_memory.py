"""What a fragment of the set-similarity join holds in a worker, and that it counts the same."""

from __future__ import annotations

import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from hazeline.llm import jaccard


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def prefixes(entries: int, each: int, keys: int) -> pa.Table:
    """A fragment of the screen in which every shingle has a row of its own in ``own``."""
    rnd = np.random.default_rng(3)
    rows = []
    for _ in range(entries // each):
        low = np.zeros((each, 8), np.uint8)
        low[:] = rnd.integers(0, keys, each, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        own, place = np.unique(rnd.integers(-(1 << 62), 1 << 62, each), return_inverse=True)
        rows.append((own.tobytes(), place.astype("<u4").tobytes(), low[:, :5].tobytes()))
    return pa.table({n: pa.array(c, pa.binary()) for n, c in zip(("own", "place", "low"), zip(*rows, strict=True), strict=True)})


def test_prefixes_are_counted_by_set():
    rnd = np.random.default_rng(4)
    rows, holders = [], defaultdict(set)
    entries = []
    for _ in range(6):
        own = rnd.choice(np.arange(-20, 20), 10, replace=False).astype(np.int64)
        place, key = rnd.integers(0, 10, 50), rnd.integers(0, 400, 50)
        low = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        rows.append((own.tobytes(), place.astype("<u4").tobytes(), low.tobytes()))
        for p, k in zip(place, key, strict=True):
            holders[k].add(own[p])
            entries.append((own[p], k))
    table = pa.table({n: pa.array(c, pa.binary()) for n, c in zip(("own", "place", "low"), zip(*rows, strict=True), strict=True)})
    want = Counter(int(o) for o, k in entries if len(holders[k]) > 1)
    got = jaccard.count_prefixes(table).to_pydict()
    assert dict(zip(got["d1"], got["shared"], strict=True)) == want
    assert jaccard.count_prefixes(table.slice(0, 0)).num_rows == 0


def test_a_full_fragment_of_the_screen_is_small():
    table = prefixes(jaccard.SCREENED, 100_000, 1 << 40)
    assert peak_mb(lambda: jaccard.count_prefixes(table)) < 100
    # Every shingle in two sets is the most that is looked at further.
    assert peak_mb(lambda: jaccard.count_prefixes(prefixes(jaccard.SCREENED // 2, 100_000, jaccard.SCREENED // 8))) < 150


def test_a_full_fragment_of_sets_is_small():
    each = 20_000
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(jaccard.FRAGMENT // each):
        info = np.repeat(np.arange(i * each, (i + 1) * each)[:, None], len(jaccard.INFO), axis=1)
        rows.append((info.tobytes(), np.arange(each).astype("<u4").tobytes(), rnd.integers(0, 1 << 60, each, np.uint64).tobytes()))
    table = pa.table({n: pa.array(c, pa.binary()) for n, c in zip(("info", "place", "shingles"), zip(*rows, strict=True), strict=True)})
    assert peak_mb(lambda: jaccard.Buckets(table)) < 90
