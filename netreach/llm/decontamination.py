"""Benchmark decontamination: texts that hold an item, or nearly so, by the CGK embedding and bit-sampling LSH.

Texts and items are compared in lower case with each run of white space as one space. A text holds an item if some
stretch of it is within ``EDITS`` x the item's length edits. For each class of similar item lengths:

1. Windows of the class's length start at every letter. A window that could be within the edits shares at least
   length - Q + 1 - Q x edits of its runs of Q letters with the item (q-gram lemma), so windows with fewer runs known
   from the class's items are passed over. Runs are shorter than Q where that bound would be below 1. So this step loses
   nothing; it keeps the rest affordable.
2. The windows left and the items are embedded by CGK random walks, which turn edit distance into Hamming distance, and
   ``SAMPLES`` samples of some places of each of ``WALKS`` walks are bucket keys. Windows meet the items in their buckets.
   Places a key are set for each class, at most ``BITS``: as many as leave the recall ``TARGET`` for items with all edits
   that are allowed. For that, the Hamming shares h of ``TRIALS`` of its items (evenly from the class) with random edits
   are measured, and the recall is the mean of 1 - product over walks of (1 - (1 - h)^places)^SAMPLES. The longer the items,
   the further the walks part, and the fewer the places.
3. Each pair of text and item that met is verified exactly, by the least edit distance of the item to any stretch of the
   text around the window (bit-parallel, Sellers' recurrence).

Items shorter than Q letters are looked up as they are; null and blank items are left out. Null texts hold nothing. Items
are broadcast in slices of ``SLICE_CHARS`` letters, so any benchmark fits; texts are never shuffled. Repeated rows give
rows each, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed, as a share of an item's length.
EDITS = 0.06
Q = 10
#: Ratio of the longest to the shortest item of a class.
CLASS = 1.12
WALKS, SAMPLES, BITS = 4, 8, 6
#: The recall wanted for items with all edits that are allowed, and the items of a class that are edited to measure it.
TARGET, TRIALS = 0.95, 64
#: Letters of items in a broadcast slice.
SLICE_CHARS = 4_000_000
#: Slots of the table of known runs for each letter of a slice, and the most, as a power of two (128 MB; four a letter of a
#: full slice). A shared slot only keeps a window longer.
ROOM, SLOTS = 32, 24
SEED = 5
#: Windows embedded at a time, about, rows taken from an Arrow batch at a time.
WINDOWS, SLICE = 20_000, 128

def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run_slots(c: np.ndarray, q: int = Q, slots: int = SLOTS) -> np.ndarray:
    """The slot, below 2^``slots``, of each run of ``q`` letters, from the hashes of runs of 1, 2, 4, ... letters."""
    pieces, step, x = {1: c.astype(np.uint64)}, 1, None
    while 2 * step <= q:
        pieces[2 * step] = (pieces[step][:-step] * _M) ^ (pieces[step][step:] + np.uint64(step))
        step *= 2
    have = 0
    for step in sorted(pieces, reverse=True):
        if have + step <= q:
            part = pieces[step][have:]
            x = part if x is None else (x[:len(part)] * _M) ^ part[:len(x)]
            have += step
    x = x[:len(c) - q + 1] * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - slots)).astype(np.int64)


_M = np.uint64(0x9E3779B97F4A7C15)


def embed(strings: np.ndarray, lengths: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """CGK: rows of letters to rows of ``steps`` letters; a step writes the letter it stands on and moves on or stays.

    Whether it moves depends on the step and the letter alone; past the end it writes 0.
    """
    random = np.random.default_rng([SEED, walk])
    moves = random.integers(0, 2, (steps, 256), dtype=np.int8)
    out = np.zeros((len(strings), steps), np.uint8)
    at = np.zeros(len(strings), np.int64)
    rows = np.arange(len(strings))
    for k in range(steps):
        letter = strings[rows, np.minimum(at, strings.shape[1] - 1)]
        letter = np.where(at < lengths, letter, 0)
        out[:, k] = letter
        at += moves[k][letter]
    return out


def edited(text: str, edits: int, random: np.random.Generator) -> str:
    """``text`` after random insertions, deletions and replacements."""
    own = list(text)
    for kind, at, letter in zip(random.integers(0, 3, edits), random.random(edits), random.integers(97, 123, edits), strict=True):
        place = int(at * len(own))
        own[place:place + (kind > 0)] = [chr(letter)] if kind < 2 else []
    return "".join(own)


def places_of(texts: list[str], length: int, steps: int, most: int) -> int:
    """Places a key, for windows of ``length`` letters of a class's ``texts`` with ``most`` edits."""
    random = np.random.default_rng([SEED, length])
    trials = [texts[k * len(texts) // TRIALS] for k in range(TRIALS)] if len(texts) > TRIALS else texts
    trials = trials * -(-TRIALS // len(trials))
    after = [(edited(t, most, random) + "".join(map(chr, random.integers(97, 123, length))))[:length] for t in trials]
    size = np.full(len(trials), length)
    one, two = (np.stack([letters(codes(t[:length])) for t in part]) for part in (trials, after))
    apart = np.stack([(embed(one, size, w, steps) != embed(two, size, w, steps)).mean(1) for w in range(WALKS)])
    for places in range(BITS, 1, -1):
        missed = ((1 - (1 - apart) ** places) ** SAMPLES).prod(0)
        if 1 - missed.mean() >= TARGET:
            return places
    return 1


def keys(strings: np.ndarray, lengths: np.ndarray, steps: int, places: int):
    """Bucket keys, one array for each sample of places of each walk; places are among the steps that reach letters."""
    for walk in range(WALKS):
        e = embed(strings, lengths, walk, steps).astype(np.uint64)
        random = np.random.default_rng([SEED, walk, 1])
        for sample in range(SAMPLES):
            key = np.full(len(e), walk * SAMPLES + sample, np.uint64)
            for place in random.integers(0, steps, BITS)[:places]:
                key = (key * np.uint64(0x100000001B3)) ^ e[:, place]
            yield key * np.uint64(0x9E3779B97F4A7C15)


def least_edits(item: str, stretch: str) -> int:
    """The least edit distance between ``item`` and any part of ``stretch``."""
    n = len(item)
    if not n:
        return 0
    peq: dict[str, int] = {}
    for k, x in enumerate(item):
        peq[x] = peq.get(x, 0) | (1 << k)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for x in stretch:
        eq = peq.get(x, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        up = (minus | ~(d0 | plus)) & full
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = (down | ~(d0 | up)) & full
        minus = up & d0
        best = min(best, score)
    return best


@dataclass
class Class:
    """Items of similar length with their bucket keys."""
    length: int
    steps: int
    ids: list[int]
    texts: list[str]
    buckets: list[dict[int, list[int]]]
    q: int
    least_runs: int
    places: int


_NONE, _NO_CLASS = np.empty(0, np.int64), np.empty(0, np.uint64)


def letters(c: np.ndarray) -> np.ndarray:
    """Letters in one byte, never 0."""
    return (c % 255 + 1).astype(np.uint8)


class Finder:
    def __init__(self, items: list[tuple[int, str]], planned: list[int] | None = None):
        """``planned``: places a key of each class, if they are known."""
        self.short = [(i, t) for i, t in items if len(t) < Q]
        long = sorted(((i, t) for i, t in items if len(t) >= Q), key=lambda x: len(x[1]))
        #: for each length of runs and each slot the classes that know it, a bit each; classes 64 apart share one
        self.known: dict[int, np.ndarray] = {}
        self.slots = min(SLOTS, max(10, (ROOM * sum(len(t) for _, t in long)).bit_length()))
        self.classes: list[Class] = []
        k = 0
        while k < len(long):
            upto = k
            while upto < len(long) and len(long[upto][1]) <= CLASS * len(long[k][1]):
                upto += 1
            part = long[k:upto]
            length = len(part[0][1])
            most = int(EDITS * len(part[-1][1]))
            q = min(Q, length // (most + 1))
            known = self.known.setdefault(q, np.zeros(1 << self.slots, np.uint64))
            for _, t in part:
                known[run_slots(codes(t), q, self.slots)] |= np.uint64(1 << len(self.classes) % 64)
            # items are cut to the class's length for their keys: windows have that length
            rows = np.stack([letters(codes(t[:length])) for _, t in part])
            steps = 2 * length
            places = planned[len(self.classes)] if planned else places_of([t for _, t in part], length, steps, most)
            buckets: list[dict[int, list[int]]] = []
            for key in keys(rows, np.full(len(part), length), steps, places):
                found: dict[int, list[int]] = {}
                for n, x in enumerate(key.tolist()):
                    found.setdefault(x, []).append(n)
                buckets.append(found)
            self.classes.append(Class(length, steps, [i for i, _ in part], [t for _, t in part], buckets, q, length - q + 1 - q * most, places))
            k = upto
        self.fewest = {q: min(g.least_runs for g in self.classes if g.q == q) for q in self.known}

    def windows(self, text: str) -> tuple[dict[int, int], list[np.ndarray]]:
        """Short items that a plain text holds, and for each class the starts of the windows to be embedded."""
        held = {i: 0 for i, t in self.short if t in text}
        c = codes(text)
        if len(c) < Q or not self.classes:
            return held, []
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q, table in self.known.items():
            known = table[run_slots(c, q, self.slots)]
            place = np.flatnonzero(known)
            if len(place) >= self.fewest[q]:
                seen[q] = place, known[place]
        found = []
        for k, group in enumerate(self.classes if seen else ()):
            place, known = seen.get(group.q, (_NONE, _NO_CLASS))
            own = place[(known >> np.uint64(k % 64) & np.uint64(1)).astype(bool)]
            if len(own) < group.least_runs:
                found.append(_NONE)
                continue
            # a window has enough runs if the last of them that it needs is near enough to one that it starts at or before
            span, last = group.length - group.q + 1, group.least_runs - 1
            first, upto = own[:len(own) - last], own[last:]
            low, high = np.maximum(0, upto - span + 1), first
            low, high = low[low <= high], high[low <= high]
            # the starts from low to high, each once; both rise
            low = np.maximum(low, np.concatenate([[0], high[:-1] + 1]))
            count = np.maximum(0, high - low + 1)
            found.append(np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum()))
        return held, found if any(map(len, found)) else []

    def resolve(self, texts: list[str], windows: list[list[np.ndarray]], held: list[dict[int, int]]) -> None:
        """Add to ``held`` the items of each text; windows of all texts are embedded together, class by class."""
        for k, group in enumerate(self.classes):
            owner = np.repeat(np.arange(len(texts)), [len(w[k]) for w in windows])
            start = np.concatenate([w[k] for w in windows])
            plain_letters: dict[int, np.ndarray] = {}
            for upto in range(0, len(start), WINDOWS):
                own, at = owner[upto:upto + WINDOWS], start[upto:upto + WINDOWS]
                rows, length = np.zeros((len(at), group.length), np.uint8), np.zeros(len(at), np.int64)
                for n, (x, y) in enumerate(zip(own.tolist(), at.tolist(), strict=True)):
                    if x not in plain_letters:
                        plain_letters = {x: letters(codes(texts[x]))}
                    part = plain_letters[x][y:y + group.length]
                    rows[n, :len(part)], length[n] = part, len(part)
                met: dict[tuple[int, int], set[int]] = {}
                for key, bucket in zip(keys(rows, length, group.steps, group.places), group.buckets, strict=True):
                    for n in np.flatnonzero(np.isin(key, np.fromiter(bucket, np.uint64, len(bucket)))).tolist():
                        for item in bucket[int(key[n])]:
                            met.setdefault((int(own[n]), item), set()).add(int(at[n]))
                for (x, item), places in met.items():
                    self._verify(group, item, texts[x], sorted(places), held[x])

    def _verify(self, group: Class, item: int, text: str, places: list[int], held: dict[int, int]) -> None:
        """Windows whose surroundings overlap are verified as one stretch."""
        ident, own = group.ids[item], group.texts[item]
        room = int(EDITS * len(own))
        reach = len(own) + room
        first = 0
        for k in range(1, len(places) + 1):
            if k < len(places) and places[k] - room <= places[k - 1] + reach:
                continue
            if held.get(ident) == 0:
                return
            edits = least_edits(own, text[max(0, places[first] - room):places[k - 1] + reach])
            if edits <= room and edits < held.get(ident, room + 1):
                held[ident] = edits
            first = k

    def find(self, text: str) -> dict[int, int]:
        """{item: edits} of the items that a plain text holds."""
        held, windows = self.windows(text)
        if windows:
            self.resolve([text], [windows], [held])
        return held


def slices(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in slices of bounded size; each goes to the driver and from there to the tasks."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-size // SLICE_CHARS))
    for k in range(count):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k) if count > 1 else known
        items = [(r.item_id, plain(r.text)) for r in part.collect()]
        yield [x for x in items if x[1]]


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and ``items`` (item_id, edits) that its text holds, in order of item."""
    found = docs.select(*keep, F.col("text").alias("_text"), F.array().cast("array<struct<item_id:bigint,edits:int>>").alias("items"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))
    n = len(keep)
    for items in slices(benchmark):
        planned = [c.places for c in Finder(items).classes]
        shared = docs.sparkSession.sparkContext.broadcast((items, planned))  # at most about SLICE_CHARS letters

        def run(batches, shared=shared):
            finder = Finder(*shared.value)
            texts, windows, held, rows, waiting = [], [], [], [], 0

            def out():
                if texts:
                    finder.resolve(texts, windows, held)
                    items = [sorted([*before, *({"item_id": i, "edits": e} for i, e in more.items())], key=lambda x: (x["item_id"], x["edits"]))
                             for (_, before), more in zip(rows, held, strict=True)]
                    kept = pa.concat_batches([row for row, _ in rows])
                    yield pa.RecordBatch.from_arrays([*kept.columns[:n + 1], pa.array(items, kind)], names=[*keep, "_text", "items"])
                    texts.clear(), windows.clear(), held.clear(), rows.clear()

            for batch in batches:
                for k in range(0, batch.num_rows, SLICE):
                    part = batch.slice(k, SLICE)
                    settled = []
                    for at, (text, before) in enumerate(zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True)):
                        text = plain(text)
                        short, open_ = finder.windows(text)
                        if short or open_:
                            # waits until enough windows have gathered
                            texts.append(text)
                            windows.append(open_ or [_NONE] * len(finder.classes))
                            held.append(short)
                            rows.append((part.slice(at, 1), before))
                            waiting += sum(map(len, open_)) + 20
                        else:
                            settled.append(at)
                    yield pa.RecordBatch.from_arrays(part.take(pa.array(settled, pa.int64())).columns, names=[*keep, "_text", "items"])
                    if waiting >= WINDOWS:
                        yield from out()
                        waiting = 0
            yield from out()

        found = found.mapInArrow(run, found.schema)
    return found.drop("_text")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items, fewest_edits) for every row of ``docs``."""
    found = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"])
    ids = F.array_distinct(F.transform("items", lambda x: x["item_id"]))
    return found.select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"),
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("items"),
        F.array_min(F.transform("items", lambda x: x["edits"])).alias("fewest_edits"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    return matches(docs.select(F.struct("*").alias("_row"), "text"), benchmark, ["_row"]).where(F.size("items") == 0).select("_row.*")
