"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text and its paragraphs of several lines; a block matches a template
when it holds at least a share ``threshold`` of the template's distinct words. Words are ordered by their
count over all documents, rarest first. A match then must share a word of the template's
prefix and of the block's prefix, the block must be long enough, and the positions of the
first shared word must leave enough words behind it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose words must stand consecutively, and sentences of license notices.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
THRESHOLD = 0.9
#: Bytes of words: ASCII digits and letters (lower-cased) and all of a non-ASCII character; a line break stays, the rest is a space.
FOLD = bytes(10 if b == 10 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
BLANK_LINE = re.compile(rb"\n[\x09-\x0D\x20]*\n")


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def word_counts(docs: DataFrame, words: set[bytes], text_col: str) -> dict[bytes, int]:
    """How often each of ``words`` stands in all documents (at most one row per word and task)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(w for w in fold(text).split() if w in words)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


class Templates:
    """The templates' words by rank, and the prefix index."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        sets = [set(t.encode().split()) for t, _ in templates]
        order = sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.labels = [label for _, label in templates]
        self.words = [sorted(self.rank[w] for w in s) for s in sets]
        # the smallest overlap with overlap / size >= threshold, in the same double arithmetic as the share
        self.need = [next(k for k in range(1, len(w) + 1) if k / len(w) >= threshold) for w in self.words]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (own, need) in enumerate(zip(self.words, self.need)):
            for at, w in enumerate(own[:len(own) - need + 1]):
                self.index.setdefault(w, []).append((t, at))
        self.least = min(self.need)

    def match(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, share of its words in the block) at the threshold or above."""
        own = sorted({self.rank[w] for w in block if w in self.rank})
        if len(own) < self.least:
            return []
        tried, found, have = set(), [], set(own)
        for at, w in enumerate(own[:len(own) - self.least + 1]):
            for t, there in self.index.get(w, ()):
                if t in tried:
                    continue
                tried.add(t)
                size, need = len(self.words[t]), self.need[t]
                if len(own) - at < need or size - there < need:  # length and position
                    continue
                overlap = sum(x in have for x in self.words[t])
                if overlap >= need:
                    found.append((t, overlap / size))
        return found


def blocks(text: str | None) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first word, words) of every line with words and every paragraph of several such lines."""
    at = 0
    for paragraph in BLANK_LINE.split((text or "").encode("utf-8", "surrogatepass")):
        lines = [line for line in map(bytes.split, paragraph.translate(FOLD).split(b"\n")) if line]
        start = at
        for line in lines:
            yield at, line
            at += len(line)
        if len(lines) > 1:
            yield start, [w for line in lines for w in line]


def places(words: list[bytes], phrases: list[tuple[bytes, str]]) -> list[tuple[str, int]]:
    """(label, first word) wherever a phrase's words stand consecutively."""
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        at = joined.find(phrase)
        while at >= 0:
            found.append((label, joined.count(b" ", 0, at)))
            at = joined.find(phrase, at + 1)
    return found


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its number of words, the places of the phrases, and the blocks that match a template.

    The one shuffle is the count of the templates' words. Null and empty texts have no words
    and no matches; repeated rows are scanned each; a null id stays null; other columns are not read.
    """
    vocabulary = {w for t, _ in templates for w in t.encode().split()}
    index = Templates(templates, word_counts(docs, vocabulary, text_col), threshold)
    framed = [(b" " + p.encode() + b" ", label) for p, label in phrases]
    kind = ("doc_id long, n_words long, places array<struct<label:string,first_word:long>>, "
            "matches array<struct<label:string,share:double,first_word:long,n_words:long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, hits = [], [], []
            for text in batch.column(1).to_pylist():
                words = fold(text).split()
                n.append(len(words))
                at.append([{"label": k, "first_word": i} for k, i in places(words, framed)])
                own = []
                if len(index.rank.keys() & set(words)) >= index.least:
                    own = [{"label": index.labels[t], "share": share, "first_word": i, "n_words": len(block)}
                           for i, block in blocks(text) for t, share in index.match(block)]
                hits.append(own)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()),
                pa.array(at, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))),
                pa.array(hits, pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()),
                                                   ("first_word", pa.int64()), ("n_words", pa.int64())])))],
                ["doc_id", "n_words", "places", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)
