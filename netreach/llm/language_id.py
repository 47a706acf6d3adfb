"""Language identification by hyperdimensional profiles.

Each letter has a random vector of ``SIZE`` signs, drawn from a seed and its code point. Of three letters in a row the
first vector is permuted (rolled) twice, the second once, and the three are bound by multiplication; a text's profile
bundles (adds) the vectors of all its letter triples. A language's prototype bundles the profiles of its training texts.
A text has the language whose prototype has the largest cosine with its profile.

Letters are what Unicode calls letters, in lower case; whatever stands between them counts as one blank, also at both
ends, so every text with a letter has a triple. Prototypes are compared less their mean, the part that all languages share.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learned. Rows without
a language teach nothing; a null id is never held out. Equal cosines give the language that comes first by code points.
The score is the cosine, at least 0. Repeated rows give a row each; other columns are ignored; an empty table gives no
rows. A text is read in pieces of ``PIECE`` letters and profiles are exact sums, so neither memory nor the result
depends on how rows or texts are cut.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netreach.llm.common import stage
from netreach.llm.labelled import held_out

#: Numbers of a vector, and the seed of the letters' vectors.
SIZE, SEED = 1024, 29
#: Letters of a text, triples and texts handled at a time; letters and languages held in a task.
PIECE, TRIPLES, TEXTS, LETTERS, LANGUAGES = 1 << 18, 2048, 128, 16_384, 256
#: Prototypes that one pass over the texts compares; more languages take more passes.
PROTOTYPES = 4_096
#: The language of texts that have none.
NONE = "und"
BLANK, BITS = 32, 21


@functools.cache
def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Letters:
    """The letters' vectors, drawn when they are first met and forgotten when there are too many."""

    def __init__(self):
        self.place: dict[int, int] = {}
        self.signs = np.zeros((256, SIZE), np.int8)

    def _draw(self, code: int) -> int:
        at = self.place[code] = len(self.place)
        if at == len(self.signs):
            self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
        self.signs[at] = np.random.default_rng([SEED, code]).integers(0, 2, SIZE, np.int8) * 2 - 1
        return at

    def vectors(self, triples: np.ndarray) -> np.ndarray:
        """One bound vector for each triple, a number of three code points."""
        mask = (1 << BITS) - 1
        codes = np.stack([triples >> (2 * BITS), (triples >> BITS) & mask, triples & mask])
        used, where = np.unique(codes, return_inverse=True)
        if len(self.place) + len(used) > LETTERS:
            self.place.clear()
        rows = np.array([self.place[c] if c in self.place else self._draw(c) for c in used.tolist()])
        own, where = self.signs[rows], where.reshape(codes.shape)
        bound = np.roll(own, 2, 1)[where[0]]
        bound *= np.roll(own, 1, 1)[where[1]]
        bound *= own[where[2]]
        return bound


def triples_of(text: str | None):
    """Pieces (triples, how often each) of a text."""
    if not text:
        return
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    rest = np.array([BLANK], np.int64)
    for k in range(0, len(codes) + 1, PIECE):
        part = codes[k:k + PIECE]
        part = np.where(letter_table()[part], part, BLANK).astype(np.int64)
        part = np.concatenate([rest, part, [BLANK]] if k + PIECE > len(codes) else [rest, part])
        part = part[np.concatenate([[True], (part[1:] != BLANK) | (part[:-1] != BLANK)])]
        if len(part) > 2:
            yield np.unique((part[:-2] << (2 * BITS)) | (part[1:-1] << BITS) | part[2:], return_counts=True)
        rest = part[-2:]


class Profiles:
    """Profiles of texts, or sums of profiles, handled many at a time."""

    def __init__(self):
        self.letters = Letters()
        self.clear()

    def clear(self) -> None:
        self.rows: list[np.ndarray] = []
        self.found: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, row: int, text: str | None) -> None:
        for found, counts in triples_of(text):
            self.rows.append(np.full(len(found), row))
            self.found.append(found)
            self.counts.append(counts)
            self.held += len(found)

    def sums(self, into: np.ndarray) -> np.ndarray:
        """Add what was given to the rows of ``into``, whole numbers below 2**53."""
        if self.held:
            used, column = np.unique(np.concatenate(self.found), return_inverse=True)
            row, count = np.concatenate(self.rows), np.concatenate(self.counts).astype(np.float64)
            order = np.argsort(column, kind="stable")
            row, count, column = row[order], count[order], column[order]
            for k in range(0, len(used), TRIPLES):
                low, high = np.searchsorted(column, [k, k + TRIPLES])
                table = np.zeros((len(into), len(used[k:k + TRIPLES])))
                np.add.at(table, (row[low:high], column[low:high] - k), count[low:high])
                # single precision is exact while every partial sum stays below 2**24
                exact = np.float32 if table.sum(1).max(initial=0) < 1 << 24 else np.float64
                into += table.astype(exact) @ self.letters.vectors(used[k:k + TRIPLES]).astype(exact)
        self.clear()
        return into


def prototypes(docs: DataFrame) -> DataFrame:
    """(lang, profile) of the texts of each language, staged; ``profile`` is SIZE doubles as bytes.

    A task adds its texts up by language before anything is shuffled, so a language of most rows is a row a task.
    """
    def run(batches):
        profiles, place, total = Profiles(), {}, np.zeros((LANGUAGES, SIZE))

        def flush():
            profiles.sums(total)
            names = list(place)
            found = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[place[k]].tobytes() for k in names], pa.binary())], names=["lang", "profile"])
            place.clear()
            total[:] = 0
            return found

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in place and len(place) == LANGUAGES:
                    yield flush()
                profiles.add(place.setdefault(lang, len(place)), text)
                if profiles.held > PIECE:
                    profiles.sums(total)
        if place:
            yield flush()

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SIZE)
        for x in part["profile"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "profile": [total.tobytes()]})

    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    # the second sum meets one row of each language and task
    return stage(known.mapInArrow(run, "lang string, profile binary").groupBy("lang").applyInPandas(add, "lang string, profile binary"), "prototypes")


def compared(rows: DataFrame, names: list[str], sums: np.ndarray, shared: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, lang_pred and score of each text against one block of prototypes."""
    whole = sums - shared
    whole = whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-9)
    block = rows.sparkSession.sparkContext.broadcast((names, whole.T.copy()))  # at most PROTOTYPES x SIZE numbers

    def run(batches):
        profiles, (named, table) = Profiles(), block.value
        for batch in batches:
            texts, best, score = batch.column(len(keep)).to_pylist(), [], []
            for k in range(0, len(texts), TEXTS):
                part = texts[k:k + TEXTS]
                total = np.zeros((len(part), SIZE))
                for row, text in enumerate(part):
                    profiles.add(row, text)
                    if profiles.held > PIECE:
                        profiles.sums(total)
                length = np.linalg.norm(profiles.sums(total), axis=1)
                cosine = np.round((total @ table) / np.maximum(length, 1e-9)[:, None], 9)
                first = cosine.argmax(1)
                for row, at in enumerate(first.tolist()):
                    # a profile of a text with letters can cancel out, a text without letters has none
                    lettered = length[row] > 0 or next(triples_of(part[row]), None) is not None
                    best.append(named[at] if lettered else NONE)
                    score.append(float(min(1.0, max(0.0, cosine[row, at]))) if lettered else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    picked = rows.select(*keep, "text")
    schema = picked.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return picked.mapInArrow(run, schema)


def identify(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` by the ``prototypes`` in ``learned``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared, count, blocks, last = np.zeros(SIZE), 0, [], None
    while True:  # the blocks of languages in order, each of bounded size
        block = (learned if last is None else learned.where(F.col("lang") > last)).orderBy("lang").limit(PROTOTYPES).collect()
        if not block:
            break
        last = block[-1].lang
        names, sums = [r.lang for r in block], np.array([np.frombuffer(r.profile) for r in block])
        sums = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        shared, count = shared + sums.sum(0), count + len(block)
        blocks.append((names, sums))
        if len(block) < PROTOTYPES:
            break
    if not blocks:
        return rows.select("doc_id", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = shared / count if count > 1 else np.zeros(SIZE)
    if len(blocks) == 1:
        return compared(rows, *blocks[0], shared, ["doc_id"])
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
    every = None
    for names, sums in blocks:
        one = compared(rows, names, sums, shared, ["_row", "doc_id"])
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.min(F.struct(-F.col("score"), "lang_pred")).alias("b"))
    return best.select("doc_id", F.col("b.lang_pred").alias("lang_pred"), (-F.col("b.col1")).alias("score"))


def language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``, learned from the rows that are not held out."""
    learned = prototypes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where(~held_out(4, 2)))
    return identify(docs, learned).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
