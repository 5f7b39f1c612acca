"""The manifest against a plain tree."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from hazeline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `tree` string, node string, `a.b` string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(level):
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, i):
    """(left, right) of each level with several nodes."""
    for level in levels[:-1]:
        run = i // 8 * 8
        yield "".join(level[run:i]), "".join(level[i + 1 : run + 8])
        i //= 8


def expected(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        order = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = (order, climb([leaf(r, r[1]) for r in order]))
    top = climb([trees[g][1][-1][0] for g in names])
    out = collections.Counter()
    for at, g in enumerate(names):
        order, levels = trees[g]
        for i, r in enumerate(order):
            path = [*siblings(levels, i), *siblings(top, at)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf(r, r[1].translate(LOWER) if hit and r[1] is not None else r[1])
            for left, right in path:
                fold = sha(left, fold, right)
            root = top[-1][0]
            proof = sha(*[x for pair in path for x in pair])
            out[r[0], levels[0][i], levels[-1][0], root, proof, fold, fold == root] += 1
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    return collections.Counter(tuple(r) for r in merkle.verified_documents(docs).collect())


def test_rounds_proofs_and_odd_rows(spark):
    rnd = random.Random(4)
    texts = ["Ä b", "no capitals", "", None, "İ ſ Ab", "x" * 40_000 + "Y", "a\nB"]
    rows = [(i, rnd.choice(texts), rnd.choice(["en"] * 6 + ["de"]), rnd.choice(["web", None]), rnd.choice([1, None])) for i in range(1100)]
    rows += [(i, "A", f"l{i % 80}", "s", 1) for i in range(2000, 2200)]  # many groups
    rows += [(5, "Z", "one", "s", 1), (None, "Q", None, None, None), (None, None, None, None, None), (7, "A", "", "s", 1)]
    rows += [rows[3], rows[3], (3, "other", *rows[3][2:])]  # a row thrice, and an id with another text
    assert found(spark, rows) == expected(rows)


def test_small_trees(spark):
    for n in (0, 1, 9, 65):
        rows = [(i, f"Text {i}", "en", "s", i) for i in range(n)]
        assert found(spark, rows) == expected(rows)
    rows = [(1, "T", lang, "s", 1) for lang in ("b", "a")]
    assert found(spark, rows) == expected(rows)


def test_equal_rows_fill_whole_blocks(spark):
    rows = [(9, "Same", "en", "s", 1)] * 700 + [(i, "t", "de", "s", 1) for i in range(3)]
    assert found(spark, rows) == expected(rows)


def test_a_proof_shows_any_change(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1, "x", "y", "z") for i in range(30)], SCHEMA)
    changed = F.when(F.col("doc_id") == 4, F.lit("other"))
    entries = merkle.manifest(merkle.leaves(docs, changed=changed)).withColumn("fold", merkle.folded("changed"))
    assert {r["key"] for r in entries.where("fold <> root").collect()} == {4}
