"""Runs of passages compared many at a time."""

import numpy as np
import pyarrow as pa

from hazeline.llm import passages
from hazeline.llm.common import hash_runs


class Held:
    """Stands for a DataFrame: hands back the function that Spark would run."""

    def mapInArrow(self, run, schema):
        return run


def pairs(n, seed=5):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        some = draw.integers(0, 1 << 63, passages.SPAN + int(draw.integers(0, 60)), np.uint64)
        own = np.concatenate([some if i % 3 else some[::2], draw.integers(0, 1 << 63, 50, np.uint64)])
        live = draw.random(len(some)) < (0.0 if i % 5 == 0 else 0.5)
        turn = i % passages.HASHES
        key = passages.signs(some, live, np.arange(len(some) - passages.SPAN + 1), turn)[-1]
        leader = i if i % 7 == 0 else 1000 + i
        rows.append((int(key.view(np.int64)), turn, i, 3, some.tobytes(), live.astype(np.uint8).tobytes(), leader, 2, own.tobytes()))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    names = ["key", "turn", "doc_id", "low", "tokens", "live", "leader", "lead_low", "lead_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def test_runs_are_signed_together(monkeypatch):
    """Each run was signed by itself, at a dozen calls of numpy a row."""
    calls, plain = [], passages.signs
    monkeypatch.setattr(passages, "signs", lambda *a: calls.append(1) or plain(*a))
    batch = pairs(300)
    calls.clear()
    run = passages.compare_runs(Held())
    together = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert len(calls) <= passages.HASHES
    single = [r for i in range(300) for b in run(iter([batch.slice(i, 1)])) for r in b.to_pylist()]
    order = lambda rows: sorted(map(repr, rows))
    assert order(together) == order(single)
    assert any(r["tokens"] is None for r in single) and any(r["tokens"] is not None for r in single)


def test_hashes_of_some_stretches():
    tokens = np.random.default_rng(1).integers(0, 1 << 63, 400, np.uint64)
    starts = np.array([0, 1, 30, 200, 201, 354])
    assert (passages.hash_stretches(tokens, starts) == hash_runs(tokens, passages.SPAN)[starts]).all()


def test_covered_places():
    hit = np.ones(200, bool)
    hit[60:90] = False
    good = passages.enough(hit)
    want = np.zeros(200, bool)
    for i in np.flatnonzero(good):
        want[i : i + passages.SPAN] = True
    assert (passages.covered(good, 200) == want).all() and not want.all()
