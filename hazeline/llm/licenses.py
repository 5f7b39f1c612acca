"""License scans by diagonal voting.

All rolling hashes of ``K`` words of whole texts meet the positions of the same hashes in license templates in a
Spark join. A match votes for its diagonal (word in the text minus word in the template). Each diagonal is verified
on its own, by the template words its matches cover. Words put in or left out shift a text against its template, so
runs of matches on diagonals at most ``DRIFT`` words apart are chained, too, where both word and place go on; a chain
is verified by its cover and by its own length. A notice that begins anew is another chain. On top of that fixed
phrases are found wherever their words stand consecutively.

Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower case. Null or empty texts have no words, no
labels and score 0. Rows that share id and text get one row each. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.common import WORD_BYTES, Chunk, chunks, hash_runs, hash_words, utf8

K, DRIFT, COVERED = 5, 8, 0.75
# Phrases and labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# The customary notices of public licenses.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-short": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-short": "Released under the MIT License",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, place, size): a table of fixed size."""
    rows = []
    for name, text in TEMPLATES.items():
        words = text.encode().translate(WORD_BYTES).split()
        grams = hash_runs(hash_words(b" ".join(words)), K).view(np.int64).tolist()
        rows += [(gram, name, place, len(words)) for place, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template string, place int, size int")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text; ``_row`` tells texts of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("_row"), utf8().alias("_utf8"))


def grams(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, gram, word) of all runs of K words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch, "_utf8"):
                found, text, place = Chunk(texts, WORD_BYTES).runs(K)
                which = pa.array(text + start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(which), batch.column("_row").take(which),
                        pa.array(found.view(np.int64)), pa.array(place.astype(np.int32)),
                    ],
                    names=["doc_id", "_row", "gram", "word"],
                )

    return keyed(docs).mapInArrow(run, "doc_id long, _row long, gram long, word int")


def license_spans(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, _row, template, first_word, end_word, coverage."""
    matches = (
        grams(docs)
        .join(F.broadcast(template_grams(docs.sparkSession)), "gram")
        .groupBy("doc_id", "_row", "template", "size")
        .agg(F.collect_set(F.struct("word", "place")).alias("at"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (size, at) in enumerate(zip(batch.column("size").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                rows += [(i, *span) for span in verified([(m["word"], m["place"]) for m in at], size)]
            which, *columns = list(zip(*rows, strict=True)) or [()] * 4
            which = pa.array(which, pa.int32())
            kinds = [pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(which) for c in ("doc_id", "_row", "template")],
                    *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ],
                names=["doc_id", "_row", "template", "first_word", "end_word", "coverage"],
            )

    return matches.mapInArrow(
        run, "doc_id long, _row long, template string, first_word int, end_word int, coverage double"
    )


def verified(matches: list[tuple[int, int]], size: int) -> list[tuple[int, int, float]]:
    """First word, end and coverage of diagonals and chains of (word, place) that hold enough of a template."""
    diagonals: dict[int, list[tuple[int, int]]] = {}
    for word, place in sorted(matches):
        diagonals.setdefault(word - place, []).append((word, place))
    spans = list(diagonals.values())
    pieces: list[list[tuple[int, int]]] = []  # consecutive words of one diagonal
    for some in spans:
        for match in some:
            if pieces and match == (pieces[-1][-1][0] + 1, pieces[-1][-1][1] + 1):
                pieces[-1].append(match)
            else:
                pieces.append([match])
    longest = size / COVERED
    chains: list[list[tuple[int, int]]] = []
    for piece in sorted(pieces):
        word, place = piece[0]
        chains = [c for c in chains if piece[0][0] + K - c[0][0] <= longest]  # the others are in spans
        for chain in reversed(chains):
            last, before = chain[-1]
            if (
                last < word and before < place and abs(word - place - last + before) <= DRIFT
                and piece[-1][0] + K - chain[0][0] <= longest
            ):
                chain.extend(piece)
                break
        else:
            chains.append(list(piece))
            spans.append(chains[-1])
    out = set()
    for some in spans:
        cover = len({p + i for _, p in some for i in range(K)}) / size
        if cover >= COVERED and some[-1][0] + K - some[0][0] <= longest:
            out.add((some[0][0], some[-1][0] + K, cover))
    return sorted(out)


def phrases(docs: DataFrame) -> DataFrame:
    """doc_id, _row, n_words, n_base, first_word, last_word, base (labels)."""
    needles = [(f" {p} ".encode(), name) for p, name in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("_utf8"):
                words = value.as_py().translate(WORD_BYTES).split()
                line = b" " + b" ".join(words) + b" "
                places, labels = [], set()
                for needle, name in needles:
                    at = line.find(needle)
                    while at >= 0:
                        places.append(at)
                        labels.add(name)
                        at = line.find(needle, at + 1)
                ends = [line.count(b" ", 0, f(places)) for f in (min, max)] if places else [None, None]
                rows.append((len(words), len(places), *ends, sorted(labels)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_row"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "_row", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return keyed(docs).mapInArrow(
        run, "doc_id long, _row long, n_words long, n_base long, first_word long, last_word long, base array<string>"
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = F.regexp_replace("template", "-short$", "")
    found = (
        license_spans(docs)
        .groupBy("doc_id", "_row")
        .agg(F.collect_set(short).alias("_more"), F.max("coverage").alias("_best"))
        .select(F.col("doc_id").alias("_id"), F.col("_row").alias("_key"), "_more", "_best")
    )
    base = phrases(docs)
    both = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["_row"] == found["_key"]), "left")
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", more))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
