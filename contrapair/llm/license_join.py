"""License scans: an exact set-similarity join of blocks of text with license notices.

A text is cut into overlapping blocks of words, a notice is a set of words, and a pair matches if the block holds at least a
given share of the notice's words (containment). The join finds every such pair without comparing all of them:

* words are ordered by how often the whole corpus uses them, rarest first;
* prefix filter: of a notice of n words of which m must be shared, one of the n - m + 1 rarest is shared, so only blocks that
  hold such a word are formed;
* length filter: a block of fewer than m words of the notices' vocabulary can't match;
* positional filter: the words that follow a shared one in both orders bound what else can be shared.

Texts are read once. That pass leaves the places of the vocabulary's words (the few hundred words of all notices) and counts;
the later steps read only these. Notices are a parameter of bounded size (``MOST_WORDS``), so they may be broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapair.llm.common import release, slices
from contrapair.session import materialise

#: Phrases of the contract and the label of each.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Sentences of public license notices and the label of each.
NOTICES = [
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Words of the contract: maximal runs of anything but ASCII characters that are neither digits nor small letters.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Most words of all notices and phrases together; what is broadcast stays below a few megabytes.
MOST_WORDS = 30_000
SEGMENT = 1 << 20


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def segments(text: bytes) -> Iterator[bytes]:
    """Pieces of about a megabyte, cut where no word is."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(len(text), at + SEGMENT))
        to = gap.start() if gap else len(text)
        yield text[at:max(to, at + 1)]
        at = max(to, at + 1)


class Vocabulary:
    """Words of all notices and phrases, numbered in alphabetical order."""

    def __init__(self, notices: list[tuple[str, str]], phrases: dict[str, str]):
        self.sets = [(label, sorted(set(words(text.encode())))) for label, text in notices]
        self.runs = [(label, words(text.encode())) for text, label in phrases.items()]
        known = sorted({w for _, ws in [*self.sets, *self.runs] for w in ws})
        if len(known) > MOST_WORDS or sum(len(ws) for _, ws in self.sets) > MOST_WORDS or len(known) >= 1 << 15:
            raise ValueError(f"notices of more than {MOST_WORDS} words are no list to broadcast")
        if any(not ws for _, ws in [*self.sets, *self.runs]):
            raise ValueError("a notice or phrase without a word")
        self.known = known
        self.number = {w: i for i, w in enumerate(known)}

    def read(self, text: bytes) -> np.ndarray:
        """The number of each word of a text, -1 for words that aren't in the vocabulary."""
        parts = []
        for piece in segments(text):
            found = words(piece)
            parts.append(np.fromiter(map(self.number.get, found, repeat(-1)), dtype=np.int16, count=len(found)))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int16)

    def places(self, read: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Where a phrase starts, and the labels of the phrases found."""
        starts, labels = [], set()
        for label, ws in self.runs:
            room = len(read) - len(ws) + 1
            if room > 0:
                here = np.ones(room, dtype=bool)
                for i, w in enumerate(ws):
                    here &= read[i:i + room] == self.number[w]
                at = np.flatnonzero(here)
                if len(at):
                    starts.append(at)
                    labels.add(label)
        return (np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)), sorted(labels)


def occurrences(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """A row for each document: number, id, count of words, places of phrases, and where the vocabulary's words stand (packed)."""
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                         F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, at binary, word binary"
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
              ("base", pa.list_(pa.string())), ("at", pa.binary()), ("word", pa.binary())]

    def of_text(text: bytes) -> tuple:
        read = vocabulary.read(text)
        starts, labels = vocabulary.places(read)
        at = np.flatnonzero(read >= 0)
        found = bool(len(starts))
        return (len(read), len(starts), int(starts.min()) if found else None, int(starts.max()) if found else None, labels,
                at.astype("<i8").tobytes(), read[at].astype("<i2").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, 512, 8 << 20):
                made = list(zip(*map(of_text, part.column(2).to_pylist()), strict=True))
                arrays = [pa.array(v, type=t) for v, (_, t) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["row", "id", *[n for n, _ in fields]])
        release()

    return narrow.mapInArrow(run, schema)


def frequencies(found: DataFrame, n: int) -> np.ndarray:
    """How often the corpus uses each word of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(packed, dtype="<i2"), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["word", "n"])

    counts = np.zeros(n, dtype=np.int64)
    for r in found.select("word").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        counts[r["word"]] = r["n"]
    return counts


class Notices:
    """Notices as sets of ranks (0: the rarest word), with the words each must share and its prefix."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray, containment: float):
        if not 0 < containment <= 1:
            raise ValueError("containment must be above 0 and at most 1")
        self.rank = np.empty(len(counts), dtype=np.int32)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.sets = [(label, sorted(int(self.rank[vocabulary.number[w]]) for w in ws)) for label, ws in vocabulary.sets]
        self.need = [max(1, math.ceil(containment * len(ranks) - 1e-9)) for _, ranks in self.sets]

    def prefixes(self) -> list[tuple]:
        """(rank, notice, label, place, need, ranks) for each rank of a notice's prefix."""
        return [(rank, k, label, i, need, ranks) for k, ((label, ranks), need) in enumerate(zip(self.sets, self.need, strict=True))
                for i, rank in enumerate(ranks[:len(ranks) - need + 1])]


def blocks(found: DataFrame, notices: Notices, width: int, stride: int) -> DataFrame:
    """(row, block, ranks) of the blocks that hold a word of some notice's prefix and enough words for some notice.

    Block b holds the words from b * stride on, ``width`` of them.
    """
    rank, least = notices.rank, min(notices.need, default=1)
    rare = np.zeros(len(rank), dtype=bool)
    rare[[p[0] for p in notices.prefixes()]] = True
    reach = -(-width // stride)

    def of_row(at: np.ndarray, ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
        hit = at[rare[ranks]] // stride
        near = np.unique((hit[:, None] - np.arange(reach)[None, :]).ravel())
        out = []
        for b in near[near >= 0]:
            lo, hi = np.searchsorted(at, (b * stride, b * stride + width))
            held = np.unique(ranks[lo:hi])
            if len(held) >= least and rare[held].any():
                out.append((int(b), held))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.int64()),
                                               pa.array([r[2] for r in rows], type=pa.list_(pa.int32()))], names=["row", "block", "ranks"])

        for batch in batches:
            rows: list[tuple] = []
            for row, at, word in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if word:
                    rows += [(row, b, held) for b, held in of_row(np.frombuffer(at, dtype="<i8"), rank[np.frombuffer(word, dtype="<i2")])]
                if len(rows) >= 8192:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    return found.select("row", "at", "word").mapInArrow(run, "row long, block long, ranks array<int>")


def matches(held: DataFrame, notices: Notices) -> DataFrame:
    """(row, block, notice, label, shared, containment): every pair of a block and a notice that meets the threshold, once.

    Ranks are in order on both sides, so the first of the shared ones lies in the notice's prefix and passes the positional
    filter; a pair is taken where that one is met, which makes it unique without a shuffle.
    """
    spark = held.sparkSession
    prefix = spark.createDataFrame(notices.prefixes(), "rank int, notice int, label string, i int, need int, of array<int>")
    x = held.select("row", "block", "ranks", F.size("ranks").alias("size"), F.posexplode("ranks").alias("j", "rank"))
    x = x.join(F.broadcast(prefix), "rank")
    long_enough = F.col("size") >= F.col("need")
    room = 1 + F.least(F.size("of") - F.col("i") - 1, F.col("size") - F.col("j") - 1) >= F.col("need")
    x = x.where(long_enough & room).withColumn("both", F.array_intersect("ranks", "of"))
    x = x.where((F.col("both")[0] == F.col("rank")) & (F.size("both") >= F.col("need")))
    return x.select("row", "block", "notice", "label", F.size("both").alias("shared"), (F.size("both") / F.size("of")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, notices: list[tuple[str, str]] | None = None,
         phrases: dict[str, str] | None = None, containment: float = 0.8, width: int = 64, stride: int = 32) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base_labels`` are the labels of phrases that stand in the text word for word; ``labels`` has besides, for each block with
    matching notices, the label of the best one (highest containment, then most shared words, then the label that sorts last).
    ``score`` is 1 with a phrase, else the highest containment that meets the threshold, else 0. Any ``width - stride + 1``
    consecutive words lie in one block.

    * Null and empty texts and texts without a word have no words, labels or places, and score 0; texts of any length are read whole.
    * Rows of equal or null ids and equal texts are rows of their own. An empty table gives an empty one.
    * Other columns take no part, whatever their names.
    """
    vocabulary = Vocabulary(NOTICES if notices is None else notices, PHRASES if phrases is None else phrases)
    found = materialise(occurrences(docs, id_col, text_col, vocabulary))
    rules = Notices(vocabulary, frequencies(found, len(vocabulary.known)), containment)
    best = F.max(F.struct("containment", "shared", "label"))
    by_block = matches(blocks(found, rules, width, stride), rules).groupBy("row", "block").agg(best.alias("best"))
    by_row = by_block.groupBy("row").agg(F.collect_set("best.label").alias("more"), F.max("best.containment").alias("share"))
    narrow = found.select("row", "id", "n_words", "n_base", "first_word", "last_word", "base")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return narrow.join(by_row, "row", "left").select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), score.alias("score"))
