r"""Licence scan: every block of text that contains enough of a licence template, by an exact set-similarity join.

A block is ``BLOCK`` consecutive words of a text, one starting every ``STEP`` words, so any passage of up to
``BLOCK - STEP`` words lies whole in a block. A template is a set of words; a block matches if it contains at least
``THRESHOLD`` of them. Words are ordered by their count in the whole corpus, rarest first (counted exactly, for the
words of templates only, as no other word can match). Then for each template of n words and need of ceil(threshold x n):

- prefix: a matching block has one of the template's n - need + 1 rarest words, so only blocks around such a word are
  looked at;
- length: a block (cut short at a text's end) with fewer distinct template words than the need is passed over;
- position: words of the template rarer than the block's first hit are missing from it; when those alone are too many,
  the block is passed over.

What is left is counted exactly; every block at the threshold is found (``matching_blocks``). A template may also name words
that tell it from its near variants. They drop no block; they choose its labels: a match without all of its telling words
gives a label only where the block holds neither a match with all of its own nor the start of a base place.

Base places: where the words of a phrase stand consecutively, counted in words from 0. A base place gives its label and a
score of 1; otherwise the score is the highest containment found, 0 without any. Null counts as empty. Repeated rows
give rows each, other columns are ignored, an empty table gives no rows. Texts are read whole, a few at a time.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCK, STEP, THRESHOLD = 64, 32, 0.8
#: Rows taken from an Arrow batch at a time.
SLICE = 128

#: Phrases and labels of the base.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Label: (words of the template, words that tell it from near variants).
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license 2"),
    "mit": ("released under the mit license", "mit license"),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission granted"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution permitted"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "gnu license 3"),
    "lgpl": ("gnu lesser general public license", "lesser license"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc sa"),
    "cc0": ("dedicated to the public domain under cc0", "cc0"),
    "proprietary": ("confidential and proprietary do not distribute without permission", "proprietary distribute"),
}


def words_of(text: str | None) -> list[str]:
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return WORD.findall(lowered)


def texts(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield part, [words_of(x) for x in part.column(part.num_columns - 1).to_pylist()]


def template_counts(docs: DataFrame, templates: dict) -> dict[str, int]:
    """How often each word of a template occurs in the corpus: as many rows as the templates have words."""
    wanted = frozenset(w for text, _ in templates.values() for w in text.split())

    def run(batches):
        found: Counter = Counter()
        for _, rows in texts(batches):
            for own in rows:
                found.update(filter(wanted.__contains__, own))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


class Joiner:
    """The templates with their words in corpus order, and for each leading word the templates it leads."""

    def __init__(self, templates: dict, counts: dict[str, int], threshold: float):
        self.templates = []
        self.leads: dict[str, list[tuple[int, int]]] = {}
        for label, (text, telling) in templates.items():
            tokens = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
            need = -int(-threshold * len(tokens) // 1)
            for place, word in enumerate(tokens[:len(tokens) - need + 1]):
                self.leads.setdefault(word, []).append((len(self.templates), place))
            self.templates.append((label, tokens, frozenset(tokens), frozenset(telling.split()), need))

    def matches(self, words: list[str]) -> list[tuple[int, str, float, bool]]:
        """(first word, label, containment, whether all telling words are there) of every block that matches a template."""
        found: list[tuple[int, str, float, bool]] = []
        if self.leads.keys().isdisjoint(words):
            return found
        asked: dict[tuple[int, int], int] = {}
        for at, word in enumerate(words):
            for template, place in self.leads.get(word, ()):
                for block in range(max(0, (at - BLOCK) // STEP + 1), at // STEP + 1):
                    key = (block, template)
                    asked[key] = min(asked.get(key, place), place)
        sets: dict[int, frozenset[str]] = {}
        for (block, template), place in sorted(asked.items()):
            label, tokens, whole, telling, need = self.templates[template]
            if len(tokens) - place < need:
                continue
            if block not in sets:
                sets[block] = frozenset(words[block * STEP:block * STEP + BLOCK])
            own = sets[block]
            share = len(whole & own) if len(own) >= need else 0
            if share >= need:
                found.append((block * STEP, label, share / len(tokens), telling <= own))
        return found


def chosen(found: list[tuple[int, str, float, bool]], base: list[tuple[int, str]]) -> set[str]:
    """The labels of a text's matching blocks."""
    told = {start for start, _, _, telling in found if telling}
    told.update(start for start in {x[0] for x in found} if any(start <= at < start + BLOCK for at, _ in base))
    return {label for start, label, _, telling in found if telling or start not in told}


def base_places(words: list[str]) -> list[tuple[int, str]]:
    found = []
    for phrase, label in BASE:
        first, *rest = phrase.split()
        at = -1
        for _ in range(words.count(first)):
            at = words.index(first, at + 1)
            if words[at + 1:at + 1 + len(rest)] == rest:
                found.append((at, label))
    return found


def scan(docs: DataFrame, templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``."""
    counts = template_counts(docs, templates)

    def run(batches):
        join = Joiner(templates, counts, threshold)
        for part, rows in texts(batches):
            out = []
            for words in rows:
                base, more = base_places(words), join.matches(words)
                starts = [at for at, _ in base]
                labels = {x for _, x in base}
                score = 1.0 if base else max((x[2] for x in more), default=0.0)
                out.append((
                    len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                    ",".join(sorted(labels | chosen(more, base))), score,
                ))
            columns = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def matching_blocks(docs: DataFrame, templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, label, first_word, containment, telling) of every block of ``docs`` that contains enough of a template."""
    counts = template_counts(docs, templates)

    def run(batches):
        join = Joiner(templates, counts, threshold)
        for part, rows in texts(batches):
            ids = part.column(0).to_pylist()
            out = [(doc, label, start, share, telling) for doc, words in zip(ids, rows, strict=True) for start, label, share, telling in join.matches(words)]
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "first_word", "containment", "telling"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, label string, first_word long, containment double, telling boolean")
