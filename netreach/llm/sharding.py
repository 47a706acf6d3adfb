"""Minimax contiguous sharding: the smallest capacity at which the ordered groups fit, found by binary search.

Groups are equal texts (by their 64-bit hash; null counts as empty) and are never split. They are ordered by that hash.
For a capacity the greedy check fills one shard after the other; the smallest capacity that needs no more than the
wanted number is searched, and the groups are cut there.

The driver never holds all groups. It starts from the byte sums of at most ``CELLS`` ranges of the hash. As long as a
cut could fall into a range of several groups, only those ranges are summed again, more finely, until every range that
any capacity still in question could cut is a single group. The result is that of a search over all groups.

A group larger than an even share cannot be made smaller, so each such group (fewer than there are shards) gets a shard
of its own, after the others, and the search runs over the rest; otherwise one hot text would let all other shards be
uneven. Slots number a shard's rows from 0, by hash range, then by a salt of the id (a group may hold a third of all
rows), hash and id. A null ``doc_id`` sorts first; repeated rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netreach.llm.common import stage, text_or_empty

#: Ranges whose sums the driver holds at a time: at most about twice this many, whatever the input.
CELLS = 1 << 15
#: Rows that one task numbers.
ROWS_IN_A_RUN = 20_000
#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def greedy_ends(ends: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Prefix sums at which a greedy filling cuts, or None if ``shards`` do not hold everything."""
    cuts, at = [], 0
    for _ in range(shards):
        k = int(np.searchsorted(ends, at + capacity, "right"))
        now = int(ends[k - 1]) if k else 0
        cuts.append(now)
        if k == len(ends):
            return np.array(cuts)
        if now == at:  # one group alone is too large
            return None
        at = now
    return None


def smallest_capacity(ends: np.ndarray, shards: int, low: int, high: int) -> int:
    """The least feasible capacity in (low, high]; ``high`` is feasible."""
    while high - low > 1:
        mid = (low + high) // 2
        if greedy_ends(ends, mid, shards) is None:
            low = mid
        else:
            high = mid
    return high


def in_question(starts: np.ndarray, ends: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Mark the ranges that a cut at a capacity between ``low`` and ``high`` could fall into."""
    marked = np.zeros(len(ends), bool)
    first = last = 0
    for _ in range(shards):
        a, b = np.searchsorted(ends, first + low, "right"), np.searchsorted(starts, last + high, "right")
        marked[a:b] = True
        if a >= len(ends):
            break
        first, last = int(starts[a]), min(last + high, int(ends[-1]))
    return marked


def find_cuts(sums_of, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the last key of each shard but the last.

    ``sums_of(shift, ranges)`` gives arrays (key >> shift, bytes) in order of key, of all keys or of those in the given
    ranges, each a pair (shift, key >> shift).
    """
    shift = 64 - CELLS.bit_length() + 1
    cell, size = sums_of(shift, None)
    level = np.full(len(cell), shift)
    while True:
        ends = np.cumsum(size)
        starts = ends - size
        if not len(ends):
            return 0, []
        low = max(int(-(-ends[-1] // shards)), 1) - 1
        high = smallest_capacity(ends, shards, low, int(low + 1 + size.max()))
        marked = in_question(starts, ends, low + 1, high, shards) & (level > 0)
        if not marked.any():
            break
        finer = max(0, shift - max(1, int(np.log2(CELLS / marked.sum()))))
        got, sums = sums_of(finer, [(int(a), int(b)) for a, b in zip(level[marked], cell[marked], strict=True)])
        keys = np.concatenate([cell[~marked] << level[~marked], got << finer])
        order = np.argsort(keys, kind="stable")
        cell, size, level = (np.concatenate(x)[order] for x in (
            [cell[~marked], got], [size[~marked], sums], [level[~marked], np.full(len(got), finer)]))
        shift = finer
    cuts = greedy_ends(ends, high, shards)
    last = [int(np.searchsorted(ends, x, "right")) - 1 for x in cuts[:-1]]
    # a cut never falls inside a range, so the range's last key ends the shard
    return high, [(int(cell[k]) + 1 << int(level[k])) - 1 for k in last]


def minimax_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key."""
    text = text_or_empty()
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy: list[tuple[int, int]] = []
    left, found = shards, rows.groupBy("h").agg(F.sum("size").alias("bytes"))
    if total:
        # over half an even share: at most 2 x shards groups; from them, those over the share of what is left
        large = sorted(found.where(F.col("bytes") * shards * 2 > total).collect(), key=lambda r: (-r.bytes, r.h))
        for r in large:
            if left < 2 or r.bytes * left <= total:
                break
            heavy.append((r.h, r.bytes))
            total, left = total - r.bytes, left - 1
    light = rows.where(~F.col("h").isin([h for h, _ in heavy])) if heavy else rows

    def sums_of(shift: int, ranges):
        part = light
        if ranges is not None:
            by_level: dict[int, list[int]] = {}
            for level, cell in ranges:
                by_level.setdefault(level, []).append(cell)
            pieces = [
                light.join(F.broadcast(light.sparkSession.createDataFrame([(c,) for c in cells], "cell long")),
                           F.shiftright("h", level) == F.col("cell"), "left_semi")
                for level, cells in by_level.items()
            ]
            part = pieces[0]
            for x in pieces[1:]:
                part = part.unionByName(x)
        got = sorted((r.cell, r.bytes) for r in part.groupBy(F.shiftright("h", shift).alias("cell")).agg(F.sum("size").alias("bytes")).collect())
        return np.array([x for x, _ in got], np.int64), np.array([x for _, x in got], np.int64)

    _, cuts = find_cuts(sums_of, left)
    last_key = F.array(*[F.lit(x) for x in cuts]) if cuts else None
    shard = F.size(F.filter(last_key, lambda x: x < F.col("h"))) if cuts else F.lit(0)
    for k, (h, _) in enumerate(heavy):
        shard = F.when(F.col("h") == h, shards - 1 - k).otherwise(shard)
    cells = rows.groupBy(F.shiftright("h", 56).alias("cell")).agg(F.count("*").alias("n"))
    salts = max(8, (cells.agg(F.max("n")).first()[0] or 0) // ROWS_IN_A_RUN)
    placed = rows.withColumns({
        "shard": shard.cast("int"), "cell": F.shiftright("h", 56).cast("int"),
        "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"),
    })
    runs = placed.groupBy("shard", "cell", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("shard", "cell", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "cell", "salt").orderBy("h", "doc_id")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(before, ["shard", "cell", "salt"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            F.col("h").alias("group_key"),
        )
    )
