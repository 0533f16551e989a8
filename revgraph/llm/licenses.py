"""Operator 7: license scans by an exact set-similarity join of text blocks with license templates.

A text's words (lower-case ASCII letters, digits and all characters beyond ASCII) are dealt into overlapping blocks of `block` words, so that
every passage of half a block lies whole in one. A template T is contained in a block B when |B & T| >= o = ceil(threshold |T|), as sets of
words, or all of T for templates of fewer than `short` different words. Besides, B must have the words that a template requires and none of those that it excludes, which
tell a license from its relatives. All documents are counted first: template words are ordered by how many documents have them, rarest first. Then
- prefix filter: T and B share a word among the first |T| - o + 1 of T and the first |B| - o + 1 of B (of B, template words only);
- length filter: |B| >= o;
- positional filter: the words after the first meeting can still make up o.
What is left is verified on whole sets. Templates are a fixed list, so broadcasting them is bounded.

Nulls: a null text is empty and has no words. Rows are independent, repeated rows give repeated results; labels of equal score stand side by side; an empty table gives an empty one;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import written

# Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices of public licenses: label, text, words that must stand beside it, words that must not.
TEMPLATES = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "affero", ""),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache", ""),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "basis governing", ""),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", "accompanying organization", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary", ""),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions binary disclaimer", ""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution", "noncommercial noderivatives sharealike noncommercially nc nd sa"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "noncommercial", "noderivatives sharealike nd sa"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "sharealike", "noncommercial nc"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public", "affero lesser library"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "gnu general public", "affero lesser library"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee", ""),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lesser", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "granted associated deal", ""),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "substantial portions", ""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered", ""),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "anyone compiled", ""),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "authors held liable", ""),
]

#: All ASCII bytes but digits and lower-case letters become spaces.
APART = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(APART).split() if text else []


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How many documents have each word of a small vocabulary."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(vocabulary.intersection(words(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    counted = docs.select("text").mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(w): n for w, n in counted.collect()}  # a row for each word of the vocabulary


def base_places(found: list[bytes]) -> dict[str, list[int]]:
    """Starts of the phrases' places, by label."""
    out: dict[str, list[int]] = {}
    have, joined = set(found), b""
    for phrase, label in PHRASES.items():
        if have.issuperset(parts := phrase.encode().split()):
            joined = joined or b" " + b" ".join(found) + b" "
            sought, at = b" " + b" ".join(parts) + b" ", -1
            word, counted = 0, 0
            while (at := joined.find(sought, at + 1)) >= 0:
                word += joined.count(b" ", counted, at)
                counted = at
                out.setdefault(label, []).append(word)
    return out


def needs(size: int, threshold: Fraction, short: int) -> int:
    """How many of a template's `size` words a block must have."""
    return size if size < short else -(-threshold.numerator * size // threshold.denominator)


def scan(docs: DataFrame, threshold: Fraction = Fraction(4, 5), block: int = 128, short: int = 16) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (greatest containment of a template that meets the threshold; 1 with a phrase)."""
    sets = [frozenset(words(text)) for _, text, _, _ in TEMPLATES]
    sides = [[frozenset(words(x)) for x in t[2:]] for t in TEMPLATES]
    vocabulary = frozenset().union(*sets, *(x for both in sides for x in both))
    counts = word_counts(docs, vocabulary)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ordered = [sorted(rank[w] for w in s) for s in sets]
    need = [needs(len(s), threshold, short) for s in sets]
    least = min(need)
    heads = frozenset(w for w, k in rank.items() if any(k in s[: len(s) - o + 1] for s, o in zip(ordered, need, strict=True)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                found = words(text.as_py())
                places = base_places(found)
                starts = sorted(x for p in places.values() for x in p)
                out.append((row, doc, len(found), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(places)), None))
                if not heads.isdisjoint(found):
                    for k in range(0, max(1, len(found) - block // 2), block // 2):
                        tokens = sorted({rank[w] for w in found[k : k + block] if w in rank})
                        if len(tokens) >= least and not heads.isdisjoint(found[k : k + block]):
                            out.append((row, None, None, None, None, None, None, tokens))
            types = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.int32())]
            columns = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "block"])

    schema = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, block array<int>"
    scanned = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, schema), "scanned")
    template = docs.sparkSession.createDataFrame(
        [
            (k, label, s, [rank[w] for w in required], [rank[w] for w in excluded], o, s[i], i)
            for k, ((label, *_), (required, excluded), s, o) in enumerate(zip(TEMPLATES, sides, ordered, need, strict=True))
            for i in range(len(s) - o + 1)
        ],
        "template int, label string, tokens array<int>, required array<int>, excluded array<int>, need int, token int, i int",
    )
    blocks = scanned.where("block is not null").select("row", "block", F.monotonically_increasing_id().alias("b"))
    met = blocks.select("*", F.posexplode("block").alias("j", "token")).join(F.broadcast(template), "token")
    met = met.where((F.size("block") >= F.col("need")) & (F.col("j") <= F.size("block") - F.col("need")))
    first = met.groupBy("row", "b", "template").agg(F.min(F.struct("i", "j")).alias("at"), *(F.first(c).alias(c) for c in ("block", "tokens", "required", "excluded", "need", "label")))
    # Up to the first meeting nothing else is shared.
    able = first.where(1 + F.least(F.size("tokens") - F.col("at.i"), F.size("block") - F.col("at.j")) - 1 >= F.col("need"))
    able = able.withColumn("shared", F.size(F.array_intersect("tokens", "block"))).where("shared >= need")
    able = able.where((F.size(F.array_except("required", "block")) == 0) & ~F.arrays_overlap("excluded", "block"))
    hits = able.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.size("tokens")).alias("contained"))
    out = scanned.where("block is null").join(hits, "row", "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
