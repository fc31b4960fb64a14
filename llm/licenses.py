"""License scans: phrases at their places, and an exact set-similarity join of text blocks with license templates.

Blocks are lines, paragraphs, and windows of as many words as a template has, which slide across all line ends; the
words that only mark comments (PREFIXES) are left out. A block's and a template's tokens are their distinct pairs of
neighbouring words. Tokens are in order of their frequency in lines over the whole corpus, rare ones first, which Spark counts in a pass of its own. A template
meets a block at least at containment |block and template| >= threshold * |template|, so the block holds one of the
first |template| - need + 1 template tokens (prefix filter), has need tokens at least (length filter), and at each
match enough of both orders is left (positional filter). Templates are given by the caller, so their index goes to every
task; documents are never shuffled.

Lines, paragraphs and windows all go through these filters, so whole license texts, hundreds of them, cost a document
little unless it holds rare tokens of theirs. Paragraphs and windows are looked at only around the places of prefix
tokens; there a template's containment is kept as the window slides. A template of fewer than two words has no tokens
and meets nothing.

A null or empty text has no words, no labels and score 0. Words never join across documents; phrases, paragraphs and
windows run over line ends. Repeated rows come back each; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import small, texts

#: phrase and label
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences of public licenses, with labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
)
THRESHOLD = 0.75
#: Words that mark comment lines; other marks are no words.
PREFIXES = frozenset((b"rem", b"dnl"))

#: Lower-cases A-Z; ASCII but letters, digits and line ends becomes a space.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c == 10 else 32 for c in range(256))


def pairs(words: Sequence[bytes]) -> list[tuple[bytes, bytes]]:
    return list(zip(words, words[1:], strict=False))


def unwrapped(clean: bytes) -> tuple[list[bytes], list[int]]:
    """The words of a cleaned text without comment words at the starts of lines, and where its paragraphs end."""
    words: list[bytes] = []
    ends: list[int] = []
    for line in clean.split(b"\n"):
        x = line.split()
        if x and x[0] in PREFIXES:
            del x[0]
        if x:
            words += x
        elif words and (not ends or ends[-1] < len(words)):
            ends.append(len(words))
    return words, ends + [len(words)]


def frequencies(docs: DataFrame, tokens: set[tuple[bytes, bytes]]) -> dict[tuple[bytes, bytes], int]:
    """How many blocks hold each template token; one row a token and task."""
    names = sorted(tokens)
    number = {t: i for i, t in enumerate(names)}
    firsts = {t[0] for t in names}

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(names)
        for b in small(it):
            for text in texts(b):
                clean = (text or b"").translate(_CLEAN)
                if firsts.isdisjoint(clean.split()):
                    continue
                for line in clean.split(b"\n"):
                    for t in {*pairs(line.split())} & number.keys():
                        n[number[t]] += 1
        yield pa.RecordBatch.from_pydict({"token": range(len(names)), "n": n}, pa.schema([("token", pa.int32()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {names[r.token]: r.n for r in rows}


def around(hits: list[int], width: int) -> Iterator[tuple[int, int]]:
    """First and last place of the stretches that windows of so many pairs around ascending hits cover."""
    low, high = hits[0] - width + 1, hits[0] + width - 1
    for i in hits[1:]:
        if i - width + 1 > high:
            yield low, high
            low = i - width + 1
        high = i + width - 1
    yield low, high


def paragraphs(hits: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """First and last pair of the paragraphs that hold ascending hits; a pair across an end is in none."""
    last = -1
    for i in hits:
        e = bisect_right(ends, i + 1)
        start = ends[e - 1] if e else 0
        if e != last and i >= start:
            last = e
            yield start, ends[e] - 2


class Index:
    """The templates' side of the join."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[tuple[bytes, bytes], int], threshold: float) -> None:
        self.threshold = threshold
        self.templates = []
        sets = [(label, {*pairs(text.encode().translate(_CLEAN).split())}) for label, text in templates]
        self.lengths = [len(text.encode().translate(_CLEAN).split()) for _, text in templates]
        every = sorted({t for _, s in sets for t in s}, key=lambda t: (frequency.get(t, 0), t))
        self.order = {t: i for i, t in enumerate(every)}
        self.prefix = defaultdict(list)
        self.prefix_of_rank = defaultdict(list)
        self.sets = []
        for label, s in sets:
            ranks = sorted(self.order[t] for t in s)
            need = -(-int(round(threshold * 1_000_000)) * len(ranks) // 1_000_000)
            self.templates.append((label, ranks, need))
            self.sets.append(frozenset(ranks))
            for place, t in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix[every[t]].append((len(self.templates) - 1, place))
                self.prefix_of_rank[t].append(len(self.templates) - 1)
        self.firsts = {t[0] for t in self.prefix}

    def spread(self, words: list[bytes], ends: list[int]) -> Iterator[tuple[str, float]]:
        """Label and containment of each template that a paragraph or a window of its length meets. ends: where paragraphs end."""
        ranks_at = [(i, r) for i, t in enumerate(pairs(words)) if (r := self.order.get(t)) is not None]
        hits = defaultdict(list)
        for i, r in ranks_at:
            for k in self.prefix_of_rank.get(r, ()):
                hits[k].append(i)
        if not hits:
            return
        held, at = {r for _, r in ranks_at}, [i for i, _ in ranks_at]
        for k in sorted(hits):
            label, ranks, need = self.templates[k]
            if len(held & self.sets[k]) < need:
                continue
            best = 0
            for low, high in around(hits[k], self.lengths[k] - 1):
                best = max(best, self.fullest(k, ranks_at[bisect_left(at, low) : bisect_right(at, high)]))
            for low, high in paragraphs(hits[k], ends):
                block = ranks_at[bisect_left(at, low) : bisect_right(at, high)]
                if self.enough(k, block):
                    best = max(best, len({r for _, r in block} & self.sets[k]))
            if best >= need:
                yield label, best / len(ranks)

    def enough(self, k: int, block: list[tuple[int, int]]) -> bool:
        """Length and positional filter: from the first of the template's tokens on, in the global order, the block has as many tokens as needed."""
        tokens = {r for _, r in block}
        first = min(tokens & self.sets[k], default=None)
        return first is not None and sum(r >= first for r in tokens) >= self.templates[k][2]

    def fullest(self, k: int, block: list[tuple[int, int]]) -> int:
        """The most tokens of the template in any window of its length within the block, 0 if there can't be as many as needed."""
        if not self.enough(k, block):
            return 0
        mine = [(i, r) for i, r in block if r in self.sets[k]]
        best, low, inside = 0, 0, defaultdict(int)
        for i, r in mine:
            inside[r] += 1
            while mine[low][0] <= i - (self.lengths[k] - 1):  # the window's first pair
                gone = mine[low][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                low += 1
            best = max(best, len(inside))
        return best

    def matches(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """Label and containment of each template that the block meets."""
        tokens = {*pairs(words)}
        hit = tokens & self.prefix.keys()
        if not hit:
            return
        mine = sorted(self.order[t] for t in tokens if t in self.order)  # others are in no template
        at = {r: i for i, r in enumerate(mine)}
        seen = set()
        for t in sorted(hit, key=self.order.__getitem__):
            for k, place in self.prefix[t]:
                label, ranks, need = self.templates[k]
                left = min(len(ranks) - place, len(mine) - at[self.order[t]])
                if k in seen or len(tokens) < need or left < need:  # at the first match nothing before counts
                    continue
                seen.add(k)
                n = len(at.keys() & set(ranks))
                if n >= need:
                    yield label, n / len(ranks)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) to SCHEMA."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = {t for _, text in templates for t in pairs(text.encode().translate(_CLEAN).split())}
    sent = spark.sparkContext.broadcast(Index(templates, frequencies(docs, tokens), threshold))
    wanted = [(tuple(p.encode().translate(_CLEAN).split()), label) for p, label in phrases]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        starts = {p[0] for p, _ in wanted} | index.firsts
        for b in small(it):
            out = []
            for text in texts(b):
                clean = (text or b"").translate(_CLEAN)
                words = clean.split()
                places, base, labels, score = [], set(), set(), 0.0
                if not starts.isdisjoint(words):
                    for p, label in wanted:
                        last = -1
                        try:
                            while True:
                                last = words.index(p[0], last + 1)
                                if tuple(words[last : last + len(p)]) == p:
                                    places.append(last)
                                    base.add(label)
                        except ValueError:
                            pass
                    for line in clean.split(b"\n"):
                        for label, part in index.matches(line.split()):
                            labels.add(label)
                            score = max(score, part)
                    for label, part in index.spread(*unwrapped(clean)):
                        labels.add(label)
                        score = max(score, part)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.mapInArrow(run, SCHEMA)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
