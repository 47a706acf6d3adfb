"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words one edit apart have letter counts at a squared distance of at most two: an inserted or deleted letter changes one
count, a replaced letter two. The letters are dealt into three classes of like frequency; as at most two counts differ,
two near words agree in all counts of at least one class. A word is therefore put into three blocks, each of the words
that have the same letters of a class. In a block the words of each length, and of adjacent lengths, are compared by a
NumPy product of their count matrices, |a|^2 + |b|^2 - 2ab; pairs at most two apart are verified letter by letter. A pair
is reported by the first class in which it agrees.

Blocks of more than ``ROWS`` words or ``LETTERS`` letters are cut into tiles by hash, and every pair of tiles is one piece
of work, so a block of any size is spread over tasks and no pair is left out. Rows of the sorted pieces stream through a
task, which holds two tiles.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF of whole texts, with A-Z in lower case. Null and empty texts
have none; repeated rows count again. A null id counts as an empty one in the planted deletion. Ties of n go to the word that
is first by code points. Other columns are ignored; an empty table gives no rows. Words may be of any length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netreach.llm.common import join_hot, small, stage
from netreach.llm.manifest import crc32_sql

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word, as the body of a regex class, and all letters that a word has after lower-casing.
LETTER = r"A-Za-zÀ-ÿ"
ALPHABET = LOWER + "".join(map(chr, range(0xC0, 0x100)))
CLASSES = 3
#: Words and letters of a tile; elements of a product or of a comparison at a time.
ROWS, TILE_LETTERS, CELLS = 4_096, 1 << 22, 1 << 22
#: Words shorter than this and rarer than this are left out; a form is so many times as frequent as its variant.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One occurrence in so many (document, word) pairs loses a letter.
EVERY = 199


def runs_of_letters(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, run): every maximal run of at least ``least`` letters, lower-cased."""
    # the pattern takes the longest run from its first letter on, so shorter runs are passed over whole
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTER}]{{{least},}}"), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(found).alias("run"))


def with_deletions(runs: DataFrame, every: int = EVERY) -> Column:
    """The run, less one letter where the checksum of its document and itself is a multiple of ``every``."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    check = F.crc32(key.cast("binary"))
    at = (check % F.char_length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return F.when(check % every == 0, less).otherwise(F.col("run"))


def word_counts(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough, over all texts."""
    runs = runs_of_letters(docs, least_length)
    words = runs.select(with_deletions(runs, every).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def letter_classes(words: DataFrame) -> list[str]:
    """The letters in ``CLASSES`` classes: by falling frequency, each to the class that is lightest so far."""
    letter = F.explode(F.split("word", "")).alias("letter")
    found = {r.letter: r["count"] for r in words.select(letter).groupBy("letter").count().collect()}  # at most the alphabet
    classes, weight = [""] * CLASSES, [0] * CLASSES
    for c in sorted(ALPHABET, key=lambda c: (-found.get(c, 0), c)):
        lightest = weight.index(min(weight))
        classes[lightest] += c
        weight[lightest] += found.get(c, 0)
    return classes


def tiles(words: DataFrame, classes: list[str], rows: int = ROWS, letters: int = TILE_LETTERS) -> DataFrame:
    """(key, left, right, side, word, n): the pieces of work; ``key`` is a class and a word's letters of that class, sorted."""
    def key(k: int) -> Column:
        kept = F.regexp_replace("word", f"[^{classes[k]}]", "") if classes[k] else F.lit("")
        return F.concat(F.lit(f"{k}:"), F.array_join(F.array_sort(F.split(kept, "")), ""))

    keyed = words.withColumn("key", F.explode(F.array(*[key(k) for k in range(CLASSES)])))
    size = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.char_length("word")).alias("letters"))
    parts = F.greatest(F.ceil(F.col("rows") / rows), F.ceil(F.col("letters") / letters)).cast("int")
    large = stage(size.select("key", parts.alias("parts")).where("parts > 1"), "large-blocks")
    cut = keyed.join(small(large), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut.select("key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).cast("int").alias("side"), "word", "n")


def same_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_longer(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a row of ``long`` less one letter is the row of ``short``: alike up to a first difference, shifted after it."""
    differs = np.logical_or.accumulate(short != long[:, :-1], axis=1)
    return ~(differs & (short != long[:, 1:])).any(1)


def near_in_piece(left: pd.DataFrame, right: pd.DataFrame | None, classes: list[str], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of near words of ``left`` and ``right`` (of ``left`` with itself if None) not met in a class before ``k``."""
    place = {c: i for i, c in enumerate(ALPHABET)}
    # letters in order of their classes, so the classes before k are the first columns
    order = [place[c] for part in classes for c in part]
    earlier = [sum(map(len, classes[:j])) for j in range(k + 1)]
    code = np.zeros(0x100, np.uint8)
    code[[ord(ALPHABET[i]) for i in order]] = np.arange(len(order), dtype=np.uint8)

    def blocks(part: pd.DataFrame) -> dict:
        lengths, found = part["word"].str.len().to_numpy(), {}
        for size in np.unique(lengths):
            rows = np.flatnonzero(lengths == size)
            text = code[np.frombuffer("".join(part["word"].iloc[rows]).encode("latin-1"), np.uint8)].reshape(len(rows), size)
            counts = np.zeros((len(rows), len(order)), np.float32 if size < 2_000 else np.float64)
            np.add.at(counts, (np.repeat(np.arange(len(rows)), size), text.ravel()), 1)
            found[size] = rows, text, counts, (counts * counts).sum(1)
        return found

    one = blocks(left)
    two = one if right is None else blocks(right)
    out = []
    for size, (rows_a, text_a, counts_a, norm_a) in one.items():
        for size_b in (size - 1, size, size + 1) if right is not None else (size, size + 1):
            if size_b not in two:
                continue
            rows_b, text_b, counts_b, norm_b = two[size_b]
            step = max(1, CELLS // len(rows_b))
            for low in range(0, len(rows_a), step):
                gram = counts_a[low:low + step] @ counts_b.T
                close = norm_a[low:low + step, None] + norm_b - 2 * gram <= 2
                i, j = np.nonzero(close)
                i += low
                if right is None and size == size_b:
                    i, j = i[i < j], j[i < j]
                for start in range(0, len(i), max(1, CELLS // size)):
                    a, b = i[start:start + max(1, CELLS // size)], j[start:start + max(1, CELLS // size)]
                    new = np.ones(len(a), bool)
                    for x, y in zip(earlier[:-1], earlier[1:], strict=True):
                        new &= (counts_a[a, x:y] != counts_b[b, x:y]).any(1)
                    a, b = a[new], b[new]
                    if size == size_b:
                        hit = same_length(text_a[a], text_b[b])
                    elif size < size_b:
                        hit = one_longer(text_a[a], text_b[b])
                    else:
                        hit = one_longer(text_b[b], text_a[a])
                    out.append((rows_a[a[hit]], rows_b[b[hit]]))
    return out


def near_words(words: DataFrame, rows: int = ROWS, letters: int = TILE_LETTERS) -> DataFrame:
    """(word, n, near, near_n): every pair of ``words`` (word, n) one edit apart, from both sides."""
    classes = letter_classes(words)

    def pairs(piece: pd.DataFrame) -> pd.DataFrame:
        k = int(piece["key"].iloc[0].split(":", 1)[0])
        split = piece["left"].iloc[0] != piece["right"].iloc[0]
        left = piece[piece["side"] == 0].reset_index(drop=True) if split else piece.reset_index(drop=True)
        right = piece[piece["side"] == 1].reset_index(drop=True) if split else None
        other = left if right is None else right
        if len(left) == 0 or len(other) < (1 if split else 2):
            return None
        found = near_in_piece(left, right, classes, k)
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(a):
            return None
        w, n, v, m = left["word"].to_numpy()[a], left["n"].to_numpy()[a], other["word"].to_numpy()[b], other["n"].to_numpy()[b]
        return pd.DataFrame({"word": np.concatenate([w, v]), "n": np.concatenate([n, m]), "near": np.concatenate([v, w]), "near_n": np.concatenate([m, n])})

    def run(batches):
        held = None  # the piece that the next batch may go on with
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = (batch[["key", "left", "right"]] != batch[["key", "left", "right"]].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                if high - low > 1:
                    found = pairs(batch.iloc[low:high])
                    if found is not None:
                        yield found
            held = batch.iloc[starts[-1]:] if len(starts) else None
        if held is not None and len(held) > 1:
            found = pairs(held)
            if found is not None:
                yield found

    pieces = tiles(words, classes, rows, letters).repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return pieces.mapInPandas(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) for links (word, form) of chains of at most ``longest`` links: each round doubles what is followed."""
    follow = forms.select("word", F.col("form").alias("to"))
    for _ in range(max(0, math.ceil(math.log2(max(longest, 1))))):
        # a form of very many words is met in parts
        follow = stage(follow, "follow")
        onward = follow.select(F.col("word").alias("to"), F.col("to").alias("onward"))
        moved = join_hot(follow, onward, "to", "word").select("word", F.col("onward").alias("to"))
        follow = moved.unionByName(follow.join(moved.select("word"), "word", "left_anti"))
    return follow.withColumnRenamed("to", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), distinct words of the letters in ``ALPHABET``; they are read several times."""
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    table = words.join(best, "word", "left")
    enough = -F.col("best.n") >= times * F.col("n")
    table = stage(table.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "forms")
    most = table.agg(F.max("n")).first()[0] or 1
    # each link multiplies n by ``times`` at least
    found = roots(table.where("form IS NOT NULL"), max(1, math.ceil(math.log(most, max(times, 2))) + 1))
    return table.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of ``docs`` with a letter deleted at every ``EVERY``-th place."""
    return variants(stage(word_counts(docs), "words"))


def sql() -> str:
    """The same over ``documents`` in DuckDB; letters beyond ASCII become single bytes, as its edit distance counts bytes."""
    spare = "".join(c for c in map(chr, range(0x21, 0x7F)) if c not in LOWER and c not in "'{}\\")
    wide, least = ALPHABET[26:], "[A-Za-z\\x{C0}-\\x{FF}]+"
    spare = (spare + "".join(map(chr, range(1, 9))))[:len(wide)]
    plain = f"translate(word, '{wide}', '{spare}')"
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{least}')) AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
h AS (SELECT *, {crc32_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM o),
c AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n, {plain} AS plain, length(word) AS size FROM c GROUP BY word HAVING sum(n) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM w a JOIN w b ON a.size = b.size AND levenshtein(a.plain, b.plain) = 1
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM w a JOIN w b ON a.size = b.size + 1 AND levenshtein(a.plain, b.plain) = 1
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM w a JOIN w b ON a.size = b.size - 1 AND levenshtein(a.plain, b.plain) = 1),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {TIMES} * w.n THEN b.near END AS form, CASE WHEN b.near_n >= {TIMES} * w.n THEN b.near_n END AS form_n
  FROM w LEFT JOIN best b ON w.word = b.word AND b.k = 1),
up (word, last) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.last AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word JOIN f g ON up.last = g.word WHERE g.form IS NULL
"""
