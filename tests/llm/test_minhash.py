"""Near copies against all pairs of sets."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from hazeline.llm import minhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, node string, n long, `a.b` string, component string"


def shingles(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").translate(LOWER).encode()) if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def expected(rows):
    """Rows that share an id but not the text are nodes of their own."""
    nodes = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = [shingles(t) for _, t in nodes]
    parent = list(range(len(nodes)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(nodes)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                parent[max(top(x), top(y))] = min(top(x), top(y))  # nodes ascend by id
    at = {n: i for i, n in enumerate(nodes)}
    out = collections.Counter()
    for i, t in rows:
        n = len(shingles(t))
        component = nodes[top(at[i, t or ""])][0] if i is not None else None
        out[i, n, component, i is None or i == component] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(1, 8))) for _ in range(500)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(prose(rnd.randint(1, 120))) for _ in range(60)]
    for size, changes in ((200, 9), (90, 3), (30, 1), (8, 1)):  # about the threshold
        for _ in range(12):
            seed = prose(size)
            for _ in range(5):
                copy = list(seed)
                for _ in range(rnd.randint(0, changes)):
                    copy[rnd.randrange(size)] = rnd.choice(vocabulary)
                texts.append(" ".join(copy))
    passage = prose(60)
    texts += [" ".join(passage + prose(rnd.randint(5, 60))) for _ in range(40)]  # much shared, few links
    chain = prose(120)
    for i in range(0, 100, 2):  # each like the next
        chain[i] = rnd.choice(vocabulary)
        texts.append(" ".join(chain))
    texts += [texts[0]] * 30 + [texts[70]] * 3 + ["", None, " ", "one", "One", "a b c", "A  b\tc", "a b c d", "x" * 30000, "a\n\n b  c", " ".join(prose(9000))]
    out = list(enumerate(texts))
    return [*out, out[3], out[75], (5, texts[90]), (None, texts[3]), (None, None)]


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "a", 1, "b", "c") for i, t in rows], SCHEMA).repartition(3)
    return docs, collections.Counter(tuple(r) for r in minhash.near_copies(docs).collect())


def test_all_links(spark, rows):
    docs, got = found(spark, rows)
    want = expected(rows)
    assert got == want
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for k, n in want.items() if k[3])
    assert found(spark, [])[1] == collections.Counter()
    assert found(spark, [(None, None), (None, "a b")])[1] == {(None, 0, None, True): 1, (None, 1, None, True): 1}


def test_links_beside_the_leader(spark):
    # B and C are alike, A is like neither but shares most of their words; many times, so that A leads some keys.
    rnd = random.Random(1)
    rows = []
    for g in range(25):
        b = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
        a, c = list(b), list(b)
        for i in (10, 30, 50):
            a[i] = "other"
        c[70] = "changed"
        rows += [(3 * g, " ".join(a)), (3 * g + 1, " ".join(b)), (3 * g + 2, " ".join(c))]
    assert found(spark, rows)[1] == expected(rows)


def test_every_pair_within_the_distance_shares_a_key():
    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 1 << 16, (3000, 64)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rnd.choice(64, minhash.DISTANCE, replace=False)
        row[at] ^= rnd.integers(1, 1 << 16, len(at)).astype(np.uint16)
    assert (minhash.keys_of(a) == minhash.keys_of(b)).any(axis=1).all()
    assert (minhash.from_planes(minhash.to_planes(a)) == a).all()
    p, q = minhash.to_planes(a).view(np.uint64), minhash.to_planes(b).view(np.uint64)
    assert {int(x).bit_count() for x in np.bitwise_or.reduce(p ^ q, axis=1)} == {minhash.DISTANCE}


def test_symbols_estimate_similarity():
    rnd = np.random.default_rng(6)
    differ = []
    for _ in range(200):
        x = rnd.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = minhash.signatures([np.unique(x[:800]), np.unique(x[100:])])  # 700 of 900
        differ.append((a != b).sum())
    assert abs(np.mean(differ) / 64 - 2 / 9) < 0.015
