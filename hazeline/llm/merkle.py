"""A Merkle manifest of a data set: hashes of rows, a tree per group, a tree over the groups, and proofs.

Rows of a group ascend by key. Each aligned block of 512 nodes keeps a level of its tree as one string of 64 hex
digits a node, so the parents of a level are the hashes of its substrings of 8 * 64 digits, and a node's siblings are
the two substrings that flank it. Three levels leave one node of a block; these nodes are the next round's rows, until
a group has a single block. The roots of the groups, in order, go the same way to the root of all.

Proofs come down again: a block hands the siblings above it to its nodes, so a row's whole proof is put together, hashed
and folded where its block is read, and never shuffled.

A level with several nodes joins every eight in a row (the last run may hold fewer, even one) into one hash. A group with
one row has that row's hash as its root, and one group's root is the root of all; a proof without siblings is the hash of
nothing. Null group sorts first, then bytewise; in a group, null keys first, then ascending, and rows that share a key by
hash. Rows that are equal throughout have their own places and proofs. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import land

#: Nodes joined into one, levels kept by one block, nodes of a block, and hex digits of a hash.
WIDTH, LEVELS = 8, 3
BLOCK = WIDTH**LEVELS
DIGITS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def row_hash(values: list[Column]) -> Column:
    """Hash of values in a row: each its length in bytes, a colon and itself, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, group: str = "lang", key: str = "doc_id", changed: Column | None = None, fields=FIELDS) -> DataFrame:
    """(tree, key, node, changed): hashes of the rows, and of the rows with ``changed`` as text where that isn't null.

    ``tree`` is the group as a string that sorts as groups do, null before all others.
    """
    values = {f: F.col(f"`{f}`") for f in fields}
    node = row_hash(list(values.values()))
    again = node
    if changed is not None:
        again = F.when(changed.isNotNull(), row_hash([changed if f == "text" else c for f, c in values.items()])).otherwise(node)
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col(f"`{key}`").alias("key"), node.alias("node"), again.alias("changed"))


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` with their place ``pos`` in their tree and the tree's number of rows ``n``; order: tree, key, node.

    Range partitions are numbered inside and shifted by counts of (tree, partition), so no tree is one task's work.
    The salt spreads rows that are equal throughout.
    """
    order = [F.col("tree"), F.col("key").asc_nulls_first(), F.col("node"), F.col("_salt")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.rand(7))
    ordered = salted.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_salt")
    # Ids count up from partition * 2 ** 33.
    ids = land(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.expr("_id >> 33"))
    counts = ids.groupBy("tree", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    shifts = counts.selectExpr(
        "tree", "_part", "_first",
        "sum(_rows) OVER (PARTITION BY tree ORDER BY _part) - _rows AS _before",
        "sum(_rows) OVER (PARTITION BY tree) AS n",
    )
    joined = ids.join(land(shifts, "shifts"), ["tree", "_part"])
    return joined.withColumn("pos", F.expr("_id - _first + _before")).drop("_id", "_part", "_first", "_before")


def parents(level: str) -> Column:
    """The next level's string."""
    run = WIDTH * DIGITS
    hashes = f"transform(sequence(0, (length({level}) - 1) div {run}), i -> sha2(substring({level}, i * {run} + 1, {run}), 256))"
    return F.expr(f"CAST(array_join({hashes}, '') AS BINARY)")


def build(rows: DataFrame) -> list[DataFrame]:
    """Blocks of all rounds: (tree, block, n, entries, s0 .. s3), n the tree's nodes in that round.

    ``rows`` have tree, pos, n, node and whatever else is to come back with the proofs.
    """
    rounds = []
    largest = rows.agg(F.max("n")).first()[0] or 0
    carried = [c for c in rows.columns if c not in ("tree", "pos", "n")]
    while True:
        entry = F.struct((F.col("pos") % BLOCK).cast("int").alias("slot"), *carried)
        blocks = rows.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("entries")
        )
        # Text is ASCII here, and substrings of bytes start where they start.
        blocks = blocks.withColumn("s0", F.expr("CAST(array_join(entries.node, '') AS BINARY)"))
        for j in range(LEVELS):
            blocks = blocks.withColumn(f"s{j + 1}", F.when(F.col("n") > WIDTH**j, parents(f"s{j}")).otherwise(F.col(f"s{j}")))
        rounds.append(land(blocks, "blocks"))
        if largest <= BLOCK:
            return rounds
        rows, carried = rounds[-1].where(F.col("n") > BLOCK).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
            F.col(f"s{LEVELS}").cast("string").alias("node"),
        ), ["node"]
        largest = -(-largest // BLOCK)


def proofs(rounds: list[DataFrame], tops: DataFrame | None = None) -> DataFrame:
    """Each entry of the first round with ``path``, ``subroot`` and ``root``.

    ``path`` has, level by level, what stands left and right of the node in its run. ``tops`` (tree, path, root) goes on
    above the trees' own roots.
    """
    above = None
    for blocks in reversed(rounds):
        own = F.col(f"s{LEVELS}").cast("string").alias("subroot")
        ended = blocks.where(F.col("n") <= BLOCK)
        if tops is None:
            empty = F.expr("CAST(array() AS array<struct<left: string, right: string>>)").alias("path")
            joined = ended.select("*", own, own.alias("root"), empty)
        else:
            joined = ended.join(tops.hint("merge"), "tree").select(*ended.columns, own, "root", "path")
        if above is not None:
            on = above.select("tree", F.col("pos").alias("block"), "subroot", "root", "path")
            going = blocks.where(F.col("n") > BLOCK).join(on.hint("merge"), ["tree", "block"])
            joined = joined.unionByName(going)
        steps = []
        for j in range(LEVELS):
            run, at = f"slot div {WIDTH ** (j + 1)} * {WIDTH * DIGITS}", f"slot div {WIDTH**j} % {WIDTH}"
            left = f"CAST(substring(s{j}, {run} + 1, {at} * {DIGITS}) AS STRING)"
            right = f"CAST(substring(s{j}, {run} + {at} * {DIGITS} + {DIGITS + 1}, ({WIDTH - 1} - {at}) * {DIGITS}) AS STRING)"
            steps.append(f"CASE WHEN n > {WIDTH**j} THEN array(named_struct('left', {left}, 'right', {right})) ELSE array() END")
        each = joined.select("*", F.explode("entries").alias("_entry")).withColumn("slot", F.col("_entry.slot"))
        carried = [f for f in rounds[0].schema["entries"].dataType.elementType.names if f != "slot"] if blocks is rounds[0] else ["node"]
        above = each.select(
            "tree", F.expr(f"block * {BLOCK} + slot").alias("pos"), *[F.col(f"_entry.{c}").alias(c) for c in carried],
            "subroot", "root", F.expr(f"concat({', '.join(steps)}, path)").alias("path"),
        )
        if blocks is not rounds[0]:
            above = land(above, "paths")
    return above


def proof_hash(path: str = "path") -> Column:
    """Hash of all siblings on the way up."""
    return F.expr(f"sha2(array_join(transform({path}, p -> concat(p.left, p.right)), ''), 256)")


def folded(node: str, path: str = "path") -> Column:
    """The root that follows from a node and its siblings."""
    return F.expr(f"aggregate({path}, {node}, (h, p) -> sha2(concat(p.left, h, p.right), 256))")


def manifest(rows: DataFrame) -> DataFrame:
    """Entries of ``leaves`` with path, subroot and root."""
    rounds = build(positions(rows))
    roots = None  # of each tree, in the last round it takes part in
    for blocks in rounds:
        ended = blocks.where(F.col("n") <= BLOCK).select("tree", F.col(f"s{LEVELS}").cast("string").alias("node"))
        roots = ended if roots is None else roots.union(ended)
    groups = positions(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node"))
    tops = proofs(build(groups)).select(F.col("key").alias("tree"), "path", "root")
    return proofs(rounds, land(tops, "tops"))


def lower_case(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def verified_documents(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it still fits them after some texts were tampered with.

    Texts of documents whose id has a checksum divisible by three are tampered with: A-Z to lower case. A document without
    id is not; null texts stay.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.col("text").cast("string")
    # Without capitals nothing changes.
    changed = F.when(chosen & text.rlike("[A-Z]"), lower_case(text))
    found = manifest(land(leaves(docs, changed=changed), "leaves"))
    out = found.select(
        F.col("key").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root",
        proof_hash().alias("proof_sha256"), folded("changed").alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
