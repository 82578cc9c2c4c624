"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is any stretch of twice as many words as the template has, at every start (a shorter text is one block). A block
matches when it holds at least `THRESHOLD` of the template's distinct words, and all of them if those are at most
`SHORT_WORDS`, as most words of a short notice also stand in notices of other licenses. Words are ordered by the number of
documents that hold them, rarest first, counted over all documents. A block can match only if
it holds one of the first |T| - needed + 1 words of the template (prefix filter) and enough distinct
words (length filter), and a walk over the template's words in order stops when the words still
left can't reach the threshold (positional filter). Blocks are looked at only around places of such prefix words,
with running counts of the template's words.

Matching blocks that overlap are one place; it is given with its label, its first word and the word after its last,
from the first to the last of the template's words in it.

Null text has no words, no labels and score 0. Repeated documents give repeated rows. Templates
are a parameter; one without words never matches. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import field, map_texts, slices
from rankloom.llm.decontaminate import words_of

THRESHOLD = 0.8
#: Templates of at most so many distinct words must be there with all of them.
SHORT_WORDS = 12
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public notices and their labels.
TEMPLATES = [
    ("Released under the MIT License.", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "mit",
    ),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,"
        " either version 3 of the License, or (at your option) any later version.",
        "gpl",
    ),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
]


def frequencies(df: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents each word of the templates stands; as many rows as the templates have words."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in slices(batch):
                for t in texts:
                    counts.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class Template:
    def __init__(self, text: str, label: str, frequency: dict[bytes, int], threshold: float):
        words = words_of(text.encode())
        self.label, self.size = label, 2 * len(words)
        self.words = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        self.known = set(self.words)
        self.needed = len(self.words) if len(self.words) <= SHORT_WORDS else max(1, math.ceil(threshold * len(self.words) - 1e-9))
        self.prefix = set(self.words[: len(self.words) - self.needed + 1])

    def possible(self, stretch: set[bytes]) -> bool:
        """Whether a stretch of text holds enough of the words, by a walk that stops early."""
        if len(stretch) < self.needed:
            return False
        lacking, most = 0, len(self.words) - self.needed
        for w in self.words:
            lacking += w not in stretch
            if lacking > most:
                return False
        return True

    def places(self, words: list[bytes], prefix_at: list[int]) -> list[tuple[int, int, float]]:
        """First word, word after the last and highest containment of every place, given where words of the prefix stand."""
        out: list[tuple[int, int, float]] = []
        stretches: list[list[int]] = []
        for p in sorted(prefix_at):
            a, b = max(0, p - self.size + 1), min(len(words), p + self.size)
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = b
            else:
                stretches.append([a, b])
        for a, b in stretches:
            if self.possible(set(words[a:b])):
                out += self.within(words, a, b)
        return out

    def within(self, words: list[bytes], a: int, b: int) -> list[tuple[int, int, float]]:
        at = [i for i in range(a, b) if words[i] in self.known]
        count: Counter = Counter()
        out: list[tuple[int, int, float]] = []
        first = 0
        # The best block that ends at each of the template's words: it begins at the earliest one that it can hold.
        for last, i in enumerate(at):
            count[words[i]] += 1
            while at[first] <= i - self.size:
                w = words[at[first]]
                count[w] -= 1
                if not count[w]:
                    del count[w]
                first += 1
            if len(count) >= self.needed:
                share = len(count) / len(self.words)
                if out and at[first] < out[-1][1]:
                    out[-1] = (out[-1][0], i + 1, max(out[-1][2], share))
                else:
                    out.append((at[first], i + 1, share))
        return out


def phrase_places(words: list[bytes], at: dict[bytes, list[int]], phrases: list[list[bytes]]) -> list[list[int]]:
    """Where each phrase begins; `at`: where the words of interest stand."""
    return [[p - len(f) + 1 for p in at.get(f[-1], ()) if p >= len(f) - 1 and words[p - len(f) + 1 : p + 1] == f] for f in phrases]


def scanned(df: DataFrame, *, keep: list[str], text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep`, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks.

    score: the highest containment among matching blocks, 1 where a phrase stands, else 0.
    blocks: label:first word:word after the last of every place of a template, comma-joined in that order of words.
    """
    vocabulary = {w for t, _ in templates for w in words_of(t.encode())}
    frequency = frequencies(df, vocabulary, text)
    made = [t for t in (Template(x, label, frequency, threshold) for x, label in templates) if t.size]
    found = [words_of(p.encode()) for p in phrases]
    names = list(phrases.values())
    wanted = {w for t in made for w in t.prefix} | {f[-1] for f in found}

    def one(t: bytes) -> tuple:
        words = words_of(t)
        if wanted.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0, ""
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(i)
        places = phrase_places(words, at, found)
        starts = [p for x in places for p in x]
        base = {n for n, x in zip(names, places, strict=True) if x}
        found_at = [(b, e, m.label, share) for m in made for b, e, share in m.places(words, [p for w in m.prefix for p in at.get(w, ())])]
        score = max([1.0 if base else 0.0, *(x[3] for x in found_at)])
        blocks = ",".join(f"{x}:{b}:{e}" for b, e, x in sorted({(b, e, x) for b, e, x, _ in found_at}))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in found_at})), score, blocks

    kinds = [("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"), ("blocks", pa.string(), "string")]

    def work(texts):
        columns = list(zip(*map(one, texts), strict=True)) if texts else [()] * len(kinds)
        return [pa.array(c, k) for c, (_, k, _) in zip(columns, kinds, strict=True)]

    return map_texts(df, keep, text, [field(n, s) for n, _, s in kinds], work)
